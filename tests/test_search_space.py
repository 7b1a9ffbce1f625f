"""A search of the mapped graph keeps to the disk that it needs, and finds what it found."""

import shutil
import uuid

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """A copy of the tables, and so a graph of its own."""
    from vitagraph.plans import mapping as M

    shutil.copytree(SF, at := tmp_path / f"sf-{uuid.uuid4().hex}", copy_function=shutil.copyfile)
    yield str(at)
    M._forget((spark.sparkContext.applicationId, str(at)))


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_search_builds_only_what_it_reads(spark, folder):
    from vitagraph.plans import mapping as M
    from vitagraph.plans.contract_more import search_claims
    from vitagraph.runtime import folders

    assert search_claims(spark, folder).count() == 12
    path = M._built[spark.sparkContext.applicationId, folder][1]
    assert folders(spark, path) == ["claim", "node", "terms"]
    assert not [f for f in folders(spark, path.rsplit("/", 1)[0]) if f.startswith("claim-rows")]
    part, files = M.graph(spark, folder, "claim"), M.graph(spark, folder, "claim").claim.inputFiles()
    whole = M.graph(spark, folder)
    assert M._built[spark.sparkContext.applicationId, folder][1] == path and whole.claim.inputFiles() == files
    assert folders(spark, path) == ["claim", "evidence", "listed", "node", "relation", "terms", "vocab"]
    for name in ("evidence", "listed", "relation", "vocab"):
        assert rows(getattr(part, name)) == rows(getattr(whole, name))  # a plan, and what was built of it
    assert rows(whole.claim) == rows(M.claims(spark, folder))


def test_lines_move_once_to_become_claims(spark):
    from vitagraph.plans import mapping as M

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.claims(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = sorted(line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert moved == ["c_custkey", "l_orderkey", "o_custkey", "o_orderkey"]


def test_shuffle_files_go_with_the_build(spark, folder):
    """Those of the last job too: nothing of the claims' joins is left when their index is made."""
    from vitagraph.plans import mapping as M

    held = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    M.release(spark)
    before = held()
    M.graph(spark, folder, "node", "claim")
    assert held() <= before


def test_an_index_made_in_slices_is_the_same(spark, folder, monkeypatch):
    from vitagraph.operators import search
    from vitagraph.plans import mapping as M

    g = M.graph(spark, folder, "node", "claim")
    monkeypatch.setattr(M, "INDEXED", 2_000)
    index = M.term_index(spark, folder)
    assert len({f.rsplit("/", 2)[1] for f in index.inputFiles()}) == -(-g.claim.count() // 2_000) > 1
    assert rows(index) == rows(search.build_index(search.corpus(g)))
    plain = lambda df: [tuple(r) for r in df.collect()]
    assert plain(search.search(g, "supplier 12 improves a ring", 9, index=index)) == plain(search.search(g, "supplier 12 improves a ring", 9))


def test_tasks_keep_their_best_scores(spark, monkeypatch):
    """Of 3,000 texts few are written, and all that may be among the best, also where the best come last or tie."""
    from vitagraph.operators import search

    monkeypatch.setattr(search, "TEXT_BLOCK", 100)
    texts = [("claim", f"c{k}", f"red widget {'x ' * ((k * 37) % 60)}{'blue' if k % 5 else ''}") for k in range(3000)]
    index = search.build_index(spark.createDataFrame(texts, "owner_type string, owner_id string, text string").coalesce(2))
    asked = spark.createDataFrame([("a", "red widget"), ("b", "x blue"), ("c", "zzzz qqqq")], "key string, text string")
    all_, some = search.dots(index, asked).collect(), search.dots(index, asked, 10).collect()
    assert len(some) < len(all_) / 4 and set(some) <= set(all_)
    for key in ("a", "b"):
        scores = sorted((r["score"] for r in all_ if r["key"] == key), reverse=True)
        assert {r for r in all_ if r["key"] == key and r["score"] >= scores[9]} <= set(some)
    assert search.dots(index, asked.limit(0), 10).count() == 0
    assert search.dots(index, spark.createDataFrame([("d", "")], asked.schema), 10).count() == 0


def test_an_index_of_more_than_the_graph(spark, folder):
    """Texts that are gone from the graph are no hits, and the others keep their scores."""
    from vitagraph.operators import search
    from vitagraph.plans import mapping as M

    g = M.graph(spark, folder, "node", "claim")
    index = M.term_index(spark, folder)
    best = [r["owner_id"] for r in search.search(g, "supplier 12 improves a ring", 40, "claim", index).collect()]
    less = g.with_(claim=g.claim.where(~F.col("id").isin(best)))
    plain = lambda df: [(r["owner_id"], r["score"]) for r in df.collect()]
    got = plain(search.search(less, "supplier 12 improves a ring", 30, "claim", index))
    assert got == plain(search.search(less, "supplier 12 improves a ring", 30, "claim")) and got[-1][1] > 0
