"""Queries on a small graph with known answers."""

import random
from pathlib import Path

import pytest

from vitagraph.graph import build


def n(id, type, name, **more):
    return {"id": id, "type": type, "name": name, **more}


NODES = [
    n("p:old", "population", "Older adults"),
    n("i:walk", "exercise", "Walking (outdoor)", aliases=["Brisk walks"], domains=["exercise"]),
    n("i:vit", "nutrition", "Vitamin D", external_ids=["MESH:D1"], domains=["nutrition", "odd domain"]),
    n("m:bal", "mechanism", "Balance"),
    n("o:fall", "outcome", "Fall rate", domains=["falls"]),
    n("o:mood", "outcome", "Mood"),
    n("g:gap", "knowledge_gap", "Falls at night", description="Nothing is known", domains=["falls"]),
    n("q:one", "research_question", "Does light help?"),
    n("x:far", "outcome", "Unreachable"),
]
CLAIMS = [
    dict(id="c1", type="reduces_risk_of", subject="i:walk", object="o:fall", population="p:old", mechanism="m:bal", certainty="high", status="curated", direction="decrease"),
    dict(id="c2", type="reduces_risk_of", subject="i:vit", object="o:fall", certainty="low", status="unverified"),
    dict(id="c3", type="worsens", subject="i:vit", object="o:fall", status="curated", comparator="placebo"),
    dict(id="c4", type="operates_through", subject="m:bal", object="o:mood", status="curated"),
    dict(id="c5", type="generates", subject="g:gap", object="q:one", status="curated"),
    dict(id="c6", type="related", subject="g:gap", object="o:fall", status="curated"),
    dict(id="c7", type="improves", subject="i:walk", object="missing", status="skeleton", population="o:mood"),
]
EVIDENCE = [
    dict(id="e1", claim="c1", ev_ord=0, source_id="PMID:1", study_design="rct", quote="n = 1,234"),
    dict(id="e2", claim="c1", ev_ord=1, source_id="PMID:2", study_design="cohort", quote=None),
    dict(id="e3", claim="c1", ev_ord=2, source_id="PMID:2", study_design="rct", quote="120 women"),
    dict(id="e4", claim="c2", ev_ord=0, source_id="bad source", study_design="expert_opinion", quote=None),
    dict(id="e5", claim="c3", ev_ord=0, source_id="DOI:10.1/x", study_design="guideline", quote=None),
]
RELATIONS = [dict(id="r1", type="contradicts", subject_claim="c2", object_claim="c3"), dict(id="r2", type="contradicts", subject_claim="c2", object_claim="gone")]


@pytest.fixture(scope="module")
def g(spark):
    from vitagraph import schema
    from vitagraph.runtime import ship

    ship(spark)

    def table(rows, to):
        values = [tuple({"ord": i, **r}.get(f) for f in to.names) for i, r in enumerate(rows)]
        return spark.createDataFrame(values, to)

    graph = build(spark, *[table(r, s) for r, s in ((NODES, schema.NODE), (CLAIMS, schema.CLAIM), (EVIDENCE, schema.EVIDENCE), (RELATIONS, schema.RELATION))])
    # c4 lists evidence that doesn't exist
    return graph.with_(listed=graph.listed.unionByName(spark.createDataFrame([("c4", 0, "e9")], schema.LISTED)))


def claims(df):
    return [r["claim"] for r in df.orderBy("ord").collect()]


def test_filters(g):
    from vitagraph.operators import answers as A

    assert claims(A.what_affects(g, "o:fall")) == ["c1", "c2", "c3", "c6"]
    assert claims(A.what_affects(g, "o:fall", True)) == ["c1", "c2"]
    assert claims(A.high_certainty_about(g, "o:fall")) == ["c1"]
    assert claims(A.gaps(g)) == ["c2", "c7"]
    assert claims(A.for_population(g, "p:old")) == ["c1"]
    assert claims(A.neighbourhood(g, "m:bal")) == ["c1", "c4"]
    assert claims(A.comparative(g)) == ["c3"]
    assert claims(A.list_claims(g, status="curated", object="o:fall")) == ["c1", "c3", "c6"]
    assert [r["id"] for r in A.list_nodes(g, q="BRISK").collect()] == ["i:walk"]
    assert [r["id"] for r in A.list_nodes(g, domain="falls").collect()] == ["o:fall", "g:gap"]
    with pytest.raises(ValueError):
        A.list_claims(g, colour="red")


def test_quality(g):
    from vitagraph.operators import answers as A

    rows = {r["claim"]: r for r in A.what_affects(g, "o:fall").collect()}
    c1 = rows["c1"]
    assert (c1["score"], c1["tier"], c1["best_design"], c1["n_sources"], c1["sample_size"]) == (84, "high", "rct", 2, 1234)
    assert c1["sources"] == ["PMID:1", "PMID:2", "PMID:2"]
    assert c1["reasons"] == ["strongest design: randomized controlled trial (70)", "2 independent sources (+8)", "reported sample ~1234 (+6)"]
    assert (rows["c2"]["score"], rows["c2"]["conflicted"]) == (0, True)
    assert rows["c3"]["score"] == 40
    assert rows["c6"]["reasons"] == ["no study design recorded (15)", "0 sources"]
    dangling = A.neighbourhood(g, "o:mood").where("claim = 'c4'").first()
    assert dangling["sources"] == ["e9"]
    assert A.gaps(g).where("claim = 'c7'").first()["object"] == "missing"


def test_composites(g):
    from vitagraph.operators import answers as A

    pairs = A.conflicts(g).collect()
    assert [(p["a"]["claim"], p["b"]["claim"]) for p in pairs] == [("c2", "c3")]
    land = {(r["kind"], r["a"]["claim"], r["via"]) for r in A.evidence_landscape(g, "fall rate").collect()}
    assert land == {("direct", c, None) for c in ("c1", "c2", "c3", "c6")} | {("weak", "c2", None), ("indirect", "c4", "m:bal"), ("conflicting", "c2", None)}
    assert A.evidence_landscape(g, "nothing like it").count() == 0
    gap = A.knowledge_gaps(g, "fall rate").collect()
    assert [x["id"] for x in gap] == ["g:gap"]
    assert [q["name"] for q in gap[0]["research_questions"]] == ["Does light help?"]
    assert A.knowledge_gaps(g, "moon").count() == 0
    assert A.knowledge_gaps(g, "  ").count() == 1
    assert claims(A.weak_evidence(g, "o:fall")) == ["c2"]
    assert A.resolve_topic(g, "VITAMIN").first()["id"] == "i:vit"
    assert A.resolve_topic(g, " ").count() == 0
    assert {(r["source"], r["target"], r["kind"]) for r in A.context_edges(g).collect()} == {
        ("p:old", "i:walk", "population"), ("p:old", "o:fall", "population"), ("m:bal", "i:walk", "mechanism"),
        ("m:bal", "o:fall", "mechanism"), ("o:mood", "i:walk", "population"),
    }
    assert [r["id"] for r in A.node_neighbours(g, "o:fall").orderBy("seen").collect()] == ["i:walk", "i:vit", "g:gap"]
    assert A.node_claims(g, "i:walk").count() == 2


def test_path(g):
    from vitagraph.operators.traverse import shortest_path

    p = shortest_path(g, "i:vit", "q:one", 6)
    assert p.found and p.length == 3
    assert [(r["claim"], r["forward"]) for r in p.steps.orderBy("step").collect()] == [("c2", True), ("c6", False), ("c5", True)]
    assert not shortest_path(g, "i:vit", "q:one", 2).found
    assert shortest_path(g, "i:vit", "i:vit").length == 0
    assert not shortest_path(g, "i:vit", "x:far").found
    assert shortest_path(g, "nowhere", "i:vit").from_id is None


def test_path_ties_against_a_plain_search(spark, g):
    """Random graphs: the same steps as a breadth-first search over adjacency lists in claim order."""
    from vitagraph import schema
    from vitagraph.graph import conform
    from vitagraph.operators.traverse import shortest_path

    rng = random.Random(5)
    ids = [f"n{i}" for i in range(14)]
    edges = [(f"k{i}", rng.choice(ids), rng.choice(ids)) for i in range(22)]
    node = conform(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "ord long, id string"), schema.NODE)
    claim = conform(spark.createDataFrame([(i, k, a, b) for i, (k, a, b) in enumerate(edges)], "ord long, id string, subject string, object string"), schema.CLAIM)
    h = g.with_(node=node, claim=claim)
    adj = {}
    for k, a, b in edges:
        adj.setdefault(a, []).append((b, k, True))
        adj.setdefault(b, []).append((a, k, False))
    for target in ("n5", "n11"):
        prev, seen, queue = {}, {"n0"}, ["n0"]
        while queue:
            x = queue.pop(0)
            for y, k, f in adj.get(x, []):
                if y not in seen:
                    seen.add(y)
                    prev[y] = (x, k, f)
                    queue.append(y)
        got = shortest_path(h, "n0", target, 12)
        if target not in prev:
            assert not got.found
            continue
        chain, at = [], target
        while at != "n0":
            at, k, f = prev[at]
            chain.append((k, f))
        assert [(r["claim"], r["forward"]) for r in got.steps.orderBy("step").collect()] == chain[::-1]


def test_validation(g):
    from vitagraph.operators.validate import validate

    got = {(r["rule"], r["severity"], r["id"]) for r in validate(g).collect()}
    assert got == {
        ("V2", "warning", "i:vit"), ("V5", "error", "c7"), ("V6", "warning", "c7"), ("V10", "error", "c4"),
        ("V11", "error", "e4"), ("V12", "error", "r2"),
    }


def test_search(g):
    from vitagraph.operators import search as S

    hits = S.search(g, "walking outdoors", 3).collect()
    assert hits[0]["owner_id"] == "i:walk"
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    assert {h["owner_type"] for h in S.search(g, "fall", 4, "claim").collect()} == {"claim"}
    rows = S.corpus(g)
    table = S.embeddings(rows.where("owner_type = 'node'"))
    length = table.selectExpr("aggregate(vector, 0D, (s, x) -> s + x * x) AS n").collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in length)
    assert S.missing(rows, table).count() == len(CLAIMS)
    assert S.reembed(g, table).count() == len(NODES) + len(CLAIMS)
    flags = S.cited_flags(S.hydrate(g, g.claim.where("id = 'c1'")), "see [pmid: 2]").first()
    assert flags["cited"]
    line = S.context_lines(S.hydrate(g, g.claim.where("id = 'c1'"))).first()["line"]
    assert line.startswith("Walking (outdoor) — reduces risk of (decrease) → Fall rate · population: Older adults · certainty: high")


def test_linkage(spark, g):
    from vitagraph.operators import link

    cand = spark.createDataFrame(
        [(1, "Fall rates", "outcome", []), (2, "Brisk walk", "exercise", []), (3, "Risk of falls", "outcome", []), (4, "Vitamin-D", "drug", []), (5, "The", "outcome", [])],
        "cand_id int, name string, type string, aliases array<string>",
    )
    got = {r["cand_id"]: (r["node_id"], r["score"], r["exact"]) for r in link.best_match(cand, g.node).collect()}
    assert got == {1: ("o:fall", 1.0, False), 2: ("i:walk", 1.0, False)}
    how = {r["cand_id"]: r["how"] for r in link.resolve_or_create(cand.selectExpr("cand_id", "cast(null as string) id", "name", "type", "aliases"), g).collect()}
    assert how == {1: "match", 2: "match", 3: "new", 4: "new", 5: "new"}
    wanted = spark.createDataFrame([(1, "Exercise prevents falls in older adults"), (2, "Falls")], "want_id int, title string")
    pm = spark.createDataFrame([(1, 0, "7", "Erratum: exercise prevents falls in older adults", []), (2, 1, "8", "Falls", [])], "want_id int, ord int, pmid string, title string, pubtypes array<string>")
    cr = spark.createDataFrame([(1, 0, "10.1/a/v1/review2", "Exercise prevents falls in older adults", "x"), (1, 1, "DOI:10.1/b", "Exercise prevents falls in older adults: a trial", "journal-article")], "want_id int, ord int, doi string, title string, type string")
    cites = link.resolve_citations(wanted, pm, cr).collect()
    assert [(c["want_id"], c["source_id"], c["via"]) for c in cites] == [(1, "DOI:10.1/b", "crossref")]


def test_match_nodes_sees_every_part(spark, tmp_path):
    """A name that first occurs beyond the 200th part is matched, to its first part."""
    from pyspark.sql import functions as F

    from vitagraph.plans.contract import QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumn("p_name", F.lit("plain thing"))
    key = part.schema["p_partkey"].dataType
    late = part.where("p_partkey in (1, 2)").withColumn("p_partkey", (F.col("p_partkey") + 300).cast(key)).withColumn("p_name", F.lit("rare gadget"))
    part.unionByName(late).write.parquet(str(tmp_path / "part.parquet"))
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if p.stem != "part":
            (tmp_path / p.name).symlink_to(p)
    got = {r["cand_id"]: (r["node_id"], r["score"], r["exact"]) for r in QUERIES["match_nodes"](spark, str(tmp_path)).collect()}
    assert got["pt:301"] == got["pt:302"] == ("pt:301", 1.0, True)
    assert got["pt:7"] == ("pt:0", 1.0, True) and len(got) == 202


def test_dedup(spark, g):
    from vitagraph import schema
    from vitagraph.graph import conform, listed_from
    from vitagraph.operators import link

    c = [(0, "a", "s", "o", "t", None, "unverified"), (1, "b", "s", "o", "t", None, "curated"), (2, "c", "s", "o", "t", None, "unverified"), (3, "d", "s", "o", "t", "increase", "curated")]
    claim = conform(spark.createDataFrame(c, "ord long, id string, subject string, object string, type string, direction string, status string"), schema.CLAIM)
    e = [("e1", "a", 1, "S1"), ("e2", "a", 2, "S2"), ("e3", "b", 1, "S1"), ("e4", "c", 1, "S2")]
    ev = conform(spark.createDataFrame(e, "id string, claim string, ev_ord long, source_id string"), schema.EVIDENCE)
    rel = conform(spark.createDataFrame([(0, "r1", "a", "b"), (1, "r2", "c", "d")], "ord long, id string, subject_claim string, object_claim string"), schema.RELATION)
    h = g.with_(claim=claim, evidence=ev, relation=rel, listed=listed_from(ev))
    dry, applied = link.dedup_summary(h).first(), link.dedup_summary(h, True).first()
    assert (dry["evidence_moved"], dry["evidence_dropped"]) == (2, 1)
    assert (applied["evidence_moved"], applied["evidence_dropped"]) == (1, 2)
    k = link.dedup_apply(h)
    assert sorted(r["id"] for r in k.claim.collect()) == ["b", "d"]
    assert sorted((r["id"], r["claim"]) for r in k.evidence.collect()) == [("e2", "b"), ("e3", "b")]
    assert [(r["subject_claim"], r["object_claim"]) for r in k.relation.collect()] == [("b", "d")]
    assert link.duplicate_groups(k).count() == 0


def test_writes(spark, g):
    from vitagraph.operators import writes as W

    rows = spark.createDataFrame(
        [(0, "n:new", "tool", "A tool", ["MESH:1"]), (1, "o:fall", "outcome", "Again", []), (2, "", "odd", "", ["broken"]), (3, "n:new", "tool", "Twice", [])],
        "row int, id string, type string, name string, external_ids array<string>",
    )
    h, res = W.create_nodes(g, rows)
    assert [r["status_code"] for r in res.orderBy("row").collect()] == [200, 409, 400, 409]
    assert h.node.count() == len(NODES) + 1
    made = spark.createDataFrame(
        [(0, "k1", "treats", "i:vit", "o:mood", None, None, "curated", [("PMID:5", None, None, None, None, None)]), (1, "k2", "treats", "i:vit", "o:mood", None, None, "curated", []), (2, "k3", "is_a", "i:vit", "nope", None, None, "curated", [])],
        "row int, id string, type string, subject string, object string, population string, mechanism string, status string, evidence " + W.EVIDENCE_INPUT.simpleString(),
    )
    for c in ("direction", "certainty", "setting", "rec_strength"):
        from pyspark.sql import functions as F

        made = made.withColumn(c, F.lit(None).cast("string"))
    h, res = W.create_claims(h, made)
    assert [r["status_code"] for r in res.orderBy("row").collect()] == [200, 400, 400]
    assert h.evidence.where("id = 'k1-e1'").first()["extracted_by"] == "human"
    h2, res = W.delete_nodes(h, ["i:vit", "x:far", "zzz"])
    assert {r["id"]: r["status_code"] for r in res.collect()} == {"i:vit": 409, "x:far": 200, "zzz": 404}
    h3 = W.delete_claims(h2, ["c2"])
    assert h3.claim.where("id = 'c2'").count() == 0 and h3.relation.count() == 0 and h3.evidence.where("claim = 'c2'").count() == 0
    h4 = W.add_alias(W.add_alias(h3, "o:fall", "FALL RATE"), "o:fall", "Falling")
    assert h4.node.where("id = 'o:fall'").first()["aliases"] == ["Falling"]
    s = W.set_setting(spark.createDataFrame([("a", "1")], "key string, value string"), "a", "2")
    assert W.get_setting(s, "a") == "2" and W.get_setting(s, "b", " ", "x") == "x" and W.set_setting(s, "a", None).count() == 0


def test_review(spark, g):
    from vitagraph.operators import review as R

    runs = spark.createDataFrame(
        [(1, "reviewer", "c2", '{"verdict":"no","reason":"thin"}', "2024-01-01 00:00:00"), (2, "reviewer", "c2", '{"verdict":"yes"}', "2024-01-02 00:00:00")],
        "id long, agent string, claim_id string, summary string, at string",
    ).selectExpr("id", "agent", "claim_id", "summary", "cast(at as timestamp) created_at", "cast(null as string) outcome")
    page = R.review_queue(g, runs, "all", 10, 0, "V_TAMIN").collect()
    assert sorted(r["id"] for r in page) == ["c2", "c3"]
    assert {r["id"]: r["review"]["verdict"] if r["review"] else None for r in page} == {"c2": "yes", "c3": None}
    assert R.queue_count(g, "skeleton").first()["n"] == 0  # its object is unknown
    checks = R.check_citations(g.evidence.select("claim", "source_id"), spark.createDataFrame([("pmid:1",), ("PMID:2",)], "source_id string"))
    verdicts = spark.createDataFrame([("c1", "approve"), ("c2", "approve"), ("c4", "approve")], "claim string, verdict string")
    assert {r["claim"]: r["status"] for r in R.reviewer_status(checks, verdicts).collect()} == {"c1": "curated", "c2": "needs_refinement", "c4": "needs_refinement"}
    topics = spark.createDataFrame([], "id string, topic string, status string, priority int, attempts int, last_error string, created_at timestamp")
    new = spark.createDataFrame([("Vitamin D and falls", 1), ("Vitamin d & falls!", 2), ("Other topic here", 5)], "topic string, ord int")
    topics, inserted = R.seed_topics(topics, new)
    assert sorted(r["id"] for r in inserted.collect()) == ["t:other-topic-here", "t:vitamin-d-and-falls", "t:vitamin-d-falls"]
    topics, id_ = R.claim_next_topic(topics)
    topics = R.finish_topic(topics, id_, "failed", "boom")
    assert topics.where("status = 'failed'").first()["last_error"] == "boom"
    assert R.requeue_failed(topics).where("status = 'pending'").count() == 3


def test_proposals(spark, g):
    from vitagraph.operators.propose import persist

    rows = [
        (1, "Vitamin D", "nutrition", "Fall rates", "outcome", "reduces_risk_of", None, None, "low", "A long enough title"),
        (2, "Vitamin D", "nutrition", "Sleep quality", "outcome", "improves", None, "Older adults", None, "A long enough title"),
        (3, "Vitamin D", "nutrition", "Sleep quality", "outcome", "improves", None, None, None, "A long enough title"),
        (4, "", "odd", "Sleep quality", "outcome", "improves", None, None, None, "short"),
        (5, "Vitamin D", "nutrition", "Mood", "outcome", "improves", None, None, None, "Not resolved at all"),
    ]
    cols = "cand_id int, subject_name string, subject_type string, object_name string, object_type string, relationship string, direction string, population string, certainty string, citation_title string"
    p = spark.createDataFrame(rows, cols).selectExpr("*", "cast(null as string) quote", "cast(null as string) study_design")
    resolved = spark.createDataFrame([(1, "99"), (2, "10.1234/z"), (3, "98"), (4, "97")], "cand_id int, source_id string")
    h, done = persist(g, p, resolved)
    out = {r["cand_id"]: (r["outcome"], r["claim"]) for r in done.collect()}
    assert out[1] == ("merged", "c2") and out[4][0] == out[5][0] == "skipped"
    assert out[2][0] == "created" and out[3] == ("merged", out[2][1])
    assert h.node.where("id = 'ga:sleep-quality'").count() == 1
    assert h.claim.where("status = 'unverified'").count() == 2
    assert {r["source_id"] for r in h.evidence.where(f"claim = '{out[2][1]}'").collect()} == {"DOI:10.1234/z", "PMID:98"}


def test_registry(g):
    from vitagraph.plans import registry

    assert len(registry.QUERIES) == 16
    assert claims(registry.run("what_affects", g, {"object": "o:fall", "protective": "true"})) == ["c1", "c2"]
    with pytest.raises(KeyError):
        registry.run("nope", g)
    with pytest.raises(ValueError):
        registry.run("path", g, {"from": "i:vit"})
    assert registry.integer("3.7", 5) == 3 and registry.integer("-1", 5) == 5 and registry.integer("x", 5) == 5
    assert registry.run("list_nodes", g, {"type": ""}).count() == len(NODES)
