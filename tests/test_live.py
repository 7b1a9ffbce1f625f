"""Search tables that follow writes equal those of a full rebuild."""

import pytest
from pyspark.sql import functions as F
from test_graph import g  # noqa: F401


def same(store):
    from vitagraph.operators import search

    corpus = search.corpus(store.graph)
    want = search.build_index(corpus)
    columns = sorted(want.columns)
    assert sorted(map(tuple, store.terms.rows().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    if store.vectors:
        vectors = lambda df: {r["id"]: r["vector"] for r in df.collect()}
        got, want = vectors(store.vectors.rows()), vectors(search.embeddings(corpus))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_after_writes(spark, g, tmp_path, monkeypatch):
    from vitagraph.operators import live, search

    monkeypatch.setattr(live, "SHARE", 2.0)
    monkeypatch.setattr(live, "MOST_DELTAS", 4)
    store = live.Store(g, f"file://{tmp_path}/live", vectors=search.embeddings(search.corpus(g)))
    same(store)
    node = "row int, id string, type string, name string, aliases array<string>, external_ids array<string>"
    results = store.create_nodes(spark.createDataFrame([(1, "n:new", "drug", "Brand new drug", [], []), (2, "", "drug", "no id", [], [])], node))
    assert {r["status_code"] for r in results.collect()} == {200, 400}
    same(store)
    # renaming a node changes the texts of its claims
    first = g.claim.select("subject").first()["subject"]
    kind = g.node.where(F.col("id") == first).first()["type"]
    store.update_nodes(spark.createDataFrame([(1, first, kind, "Quite another name", ["alias"], [])], node))
    same(store)
    store.add_alias("n:new", "other drug")
    same(store)
    store.delete_claims([g.claim.select("id").orderBy("id").first()["id"]])
    same(store)
    store.delete_nodes(["n:new", "n:none"])
    assert store.terms._generations()[1] == [] or len(store.terms._generations()[1]) <= 4
    same(store)
    # a generation that failed half-way is none
    base, deltas = store.terms._generations()
    g.node.select(F.lit("node").alias("owner_type"), F.col("id").alias("owner_id")).write.parquet(f"{store.terms.path}/delta-{max([base, *deltas]) + 1}/touched")
    same(store)
    store.terms.compact()
    same(store)


def test_compaction_by_share(spark, g, tmp_path):
    from vitagraph.operators import live

    store = live.Store(g, f"file://{tmp_path}/live")
    ids = g.claim.select("id")
    store.delete_claims(ids)
    assert store.terms._generations()[1] == []
    same(store)


def test_another_models_vectors(spark, g):  # noqa: F811
    """A model that fails for some owners: a later run embeds what is missing, and nothing else."""
    from vitagraph.operators import search

    asked = []

    def embed(rows, fails="node"):
        asked.append(rows.count())
        return rows.select("owner_type", "owner_id", F.when(F.col("owner_type") != fails, F.array(F.length("text").cast("double"), F.lit(0.0), F.lit(1.0))).alias("vector"))

    corpus = search.corpus(g)
    first = search.embeddings(corpus, "lengths-3", embed)
    assert {r["owner_type"] for r in first.collect()} == {"claim"} and {r["model"] for r in first.collect()} == {"lengths-3"}
    assert all(sum(x * x for x in r["vector"]) == pytest.approx(1.0) for r in first.collect())
    second = search.reembed(g, first, model="lengths-3", embed=lambda rows: embed(rows, "nothing"))
    assert second.count() == corpus.count() and asked[-1] == g.node.count()


def test_search_reads_the_generations_as_they_are(spark, g, tmp_path, monkeypatch):
    """A base that was given is neither copied nor deleted, and texts that a write made void make room for the next best."""
    from vitagraph.operators import live, search

    monkeypatch.setattr(live, "SHARE", 9.0)
    base = f"file://{tmp_path}/base"
    search.build_index(search.corpus(g)).write.parquet(base)
    store = live.Store(g, f"file://{tmp_path}/live", terms=spark.read.parquet(base))
    assert live.folders(spark, store.terms.path) == []
    hits = [(r["owner_type"], r["owner_id"]) for r in search.search(g, "walking outdoors", 4).collect()]
    store.delete_claims([i for kind, i in hits if kind == "claim"])
    kinds = {r["id"]: r["type"] for r in g.node.collect()}
    node = "row int, id string, type string, name string"
    store.update_nodes(spark.createDataFrame([(k, i, kinds[i], "zzzz") for k, (kind, i) in enumerate(hits) if kind == "node"], node))
    assert live.folders(spark, store.terms.path) == ["delta-1", "delta-2"]
    plain = lambda df: [(r["owner_id"], r["name"], r["score"]) for r in df.collect()]
    for k in (1, 3, 500):
        assert plain(search.search(store.graph, "walking outdoors", k, index=store.terms)) == plain(search.search(store.graph, "walking outdoors", k))
    same(store)
    store.terms.compact()
    same(store)
    assert live.exists(spark, f"{base}/_SUCCESS")


def test_packed_counts(spark):
    """Counts beyond a byte, texts without words, and many words: the same as the lists."""
    import numpy as np

    from vitagraph.functions import text

    rows = spark.createDataFrame([(1, "red widget " * 400), (2, None), (3, "--"), (4, "Blue x"), (5, "w" + " q7 z" * 70_000)], "k int, t string").coalesce(1)
    packed = text.packed_terms(rows, ["k"], "t").toArrow().sort_by("k")
    lists = {r["k"]: r for r in text.term_lists(rows, ["k"], "t").collect()}
    assert packed.column("k").to_pylist() == [1, 4, 5] == sorted(lists)
    for chunk in packed.to_batches():
        for k, n, counts in zip(chunk.column("k").to_pylist(), chunk.column("norm2").to_pylist(), text.unpacked(chunk.column("terms")), strict=True):
            want = np.zeros(text.DIMENSION)
            want[lists[k]["buckets"]] = lists[k]["tfs"]
            assert (counts == want).all() and n == lists[k]["norm2"] == (want * want).sum()


def test_names_that_many_claims_share_move_no_claims(spark, g):
    """Claims without a population once met in one task."""
    from vitagraph.operators import search

    plan = search.claim_corpus(g.claim, g.node)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 3
