"""Review statistics in one pass, a round's tallies, and lines within a budget."""

import random

import pytest
from pyspark.sql import functions as F
from test_graph import g  # noqa: F401


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_within_a_budget(spark, seed):
    from vitagraph.operators.prompts import within_budget

    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0, 3, 10, 50]), rng.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, id int, size int, place int")
    got = {(r["key"], r["id"]): r["upto"] for r in within_budget(df.repartition(7), 400, F.col("place"), F.col("id")).collect()}
    want = {}
    for key in ("a", "b", None):
        upto = 0
        for _, i, size, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1])):
            upto += size or 0
            if upto > 400:
                break
            want[key, i] = upto
    assert got == want
    assert within_budget(df.limit(0), 10, F.col("id")).count() == 0
    assert within_budget(df.where("size = 50"), 10, F.col("id")).count() == 0


def test_a_catalogue_holds_what_fits(g):  # noqa: F811
    from vitagraph.operators.prompts import catalogue, claim_lines, node_lines

    lines = [r["line"] for r in claim_lines(g, g.claim).orderBy("ord").collect()]
    whole = catalogue(g, 10_000, g.claim).first()
    assert whole["catalogue"].split("\n") == lines and whole["n"] == len(lines)
    assert catalogue(g, len(lines[0]) + 1, g.claim).first()["catalogue"] == lines[0]
    assert catalogue(g, 3, g.claim).first()["n"] == 0
    by_type = node_lines(g, 10_000).collect()
    assert len(by_type) == g.node.count() and all(r["line"].startswith(r["id"]) for r in by_type)


def test_review_statistics_read_each_table_once(spark, g):  # noqa: F811
    from vitagraph.operators.review import review_stats

    topics = spark.createDataFrame([("pending",), ("done",), (None,)], "status string")
    runs = spark.createDataFrame([("reviewer", "curated", 1), ("reviewer", None, 1), (None, "x", 1), ("old", "x", 30)], "agent string, outcome string, ago int")
    now = F.lit("2024-05-31").cast("timestamp")
    runs = runs.select("agent", "outcome", F.expr("timestamp'2024-05-31' - make_interval(0, 0, 0, ago)").alias("created_at"))
    made = review_stats(g, topics, runs, now)
    got = {(r["section"], r["key"], r["outcome"]): r["n"] for r in made.collect()}
    status = {r["status"]: r["count"] for r in g.claim.groupBy("status").count().collect()}
    assert {k[1]: n for k, n in got.items() if k[0] == "claims" and k[1]} == status
    assert got["claims", None, None] == g.claim.count() and got["nodes", None, None] == g.node.count()
    assert {k[1]: n for k, n in got.items() if k[0] == "topics"} == {"pending": 1, "done": 1, "?": 1, None: 3}
    assert {k[1:]: n for k, n in got.items() if k[0] == "recent"} == {("reviewer", "curated"): 1, ("reviewer", "?"): 1, ("?", "x"): 1, (None, None): 3}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Aggregate") == 1


def test_a_round_leaves_what_is_not_decided(spark, g):  # noqa: F811
    from vitagraph.operators import review

    claims = g.claim.withColumn("status", F.lit("unverified"))
    h = g.with_(claim=claims)
    n = review.reviewable(h).count()
    first = review.reviewable(h).orderBy("id").first()["id"]
    outcomes = spark.createDataFrame([(first, "curated"), ("other", "deferred")], "id string, outcome string")
    after = h.with_(claim=claims.withColumn("status", F.when(F.col("id") == first, "curated").otherwise(F.col("status"))))
    written, tallies = review.review_round(after, outcomes)
    assert tuple(tallies.first()) == (2, 1, 0, 1, n - 1)
    assert written.count() == claims.count() and written.columns == claims.columns


def test_decisions_are_logged(spark, g):  # noqa: F811
    from vitagraph import schema
    from vitagraph.operators.review import decide_claims

    rows = [(1, "c1", "approve", "low"), (2, "c2", "approve", "odd"), (3, "c3", "approve", "high"), (4, "c3", "reject", None), (5, "c3", "approve", None), (6, "zz", "reject", None), (7, "c2", "approve", "moderate"), (8, "c2", "approve", None)]
    decisions = spark.createDataFrame([(*r, f"note {r[0]}") for r in rows], "row int, id string, action string, certainty string, note string").withColumn("at", F.timestamp_seconds("row"))
    runs = spark.createDataFrame([(7, "reviewer", None, "c1", "curated", None, None)], schema.AGENT_RUN)
    after, log, results = decide_claims(g, runs, decisions)
    assert {r["row"]: (r["status_code"], r["outcome"]) for r in results.collect()} == {
        1: (200, "curated"), 2: (200, "curated"), 3: (200, "curated"), 4: (200, "rejected"), 5: (404, None), 6: (404, None), 7: (200, "curated"), 8: (200, "curated")
    }
    claims = {r["id"]: (r["status"], r["certainty"]) for r in after.claim.collect()}
    assert claims["c1"] == ("curated", "low") and claims["c2"] == ("curated", "moderate") and "c3" not in claims
    assert after.evidence.where("claim = 'c3'").count() == 0 and after.relation.where("object_claim = 'c3'").count() == 0
    human = log.where("agent = 'human'").orderBy("id").collect()
    assert [(r["id"], r["claim_id"], r["outcome"]) for r in human] == [(8, "c1", "curated"), (9, "c2", "curated"), (10, "c3", "curated"), (11, "c3", "rejected"), (12, "c2", "curated"), (13, "c2", "curated")]
    assert '"note":"note 1"' in human[0]["summary"] and '"certainty":"low"' in human[0]["summary"]
