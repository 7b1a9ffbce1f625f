"""The inverted file against brute force: exact answers, recall, cells that are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def table(spark, x):
    return spark.createDataFrame([(str(i), None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id string, v array<double>")


def brute(x, k, queries):
    x = np.asarray(x, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm == 0, 1, norm)
    cos = np.round(u @ u.T, 6)
    out = {}
    for q in queries:
        order = sorted((j for j in range(len(x)) if j != q), key=lambda j: (-cos[q, j], j))[:k]
        out[q] = [(j, cos[q, j]) for j in order]
    return out


def clustered(rng, n, dim, groups):
    centers = rng.normal(size=(groups, dim))
    return centers[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, dim))


def asked(index_rows, ids):
    return index_rows.where(F.col("id").isin(*map(str, ids))).select(F.col("id").alias("q_id"), F.col("v").alias("q"))


def test_exact_mode_equals_brute_force(spark, tmp_path):
    from vitagraph.operators import vector_index as V

    rng = np.random.default_rng(1)
    x = clustered(rng, 900, 12, 30)
    x[100] = 0  # a zero vector
    x[200:240] = x[199]  # ties
    x[300:600] = x[299]  # a third in one cell
    rows = table(spark, x).unionByName(
        spark.createDataFrame([("bad1", None), ("bad2", [1.0]), ("bad3", [float("nan")] * 12), ("bad4", [None] * 12)], "id string, v array<double>")
    )
    index = V.build(rows, f"file://{tmp_path}/cells", 25)
    assert index.members.count() == 900
    ids = [0, 5, 100, 199, 205, 300, 310, 899]
    want = brute(x, 7, ids)
    for probe in (1, 4):
        got = {}
        for r in V.search(index, asked(rows, ids), 7, probe, exact=True).orderBy("rk").collect():
            got.setdefault(int(r["q_id"]), []).append((int(r["id"]), r["cos"]))
        for q in ids:
            assert [c for _, c in got[q]] == pytest.approx([c for _, c in want[q]], abs=1.1e-6)
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] or len({c for _, c in want[q]}) < 7
    assert V.search(index, asked(rows, ["bad1", "bad3"]), 7).count() == 0


def test_blocks_change_nothing(spark, tmp_path, monkeypatch):
    from vitagraph.operators import vector_index as V

    x = clustered(np.random.default_rng(2), 300, 8, 6)
    rows = table(spark, x)
    index = V.build(rows, f"file://{tmp_path}/cells", 6)
    queries = rows.select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, V.search(index, queries, 5, 2).collect()))
    monkeypatch.setattr(V, "MEMBER_BLOCK", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    assert sorted(map(tuple, V.search(index, queries, 5, 2).collect())) == whole


def test_recall_and_cells_read_on_all_rows(spark, tmp_path):
    from vitagraph.operators import vector_index as V
    from vitagraph.operators.search import nearest

    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null")
    rows = data.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    n = rows.count()
    index = V.build(rows, f"file://{tmp_path}/cells")
    queries = rows.select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    truth = nearest(data.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), data.select(F.col("vec_id").alias("q_id"), F.col("embedding").cast("array<double>").alias("q")), 10)
    truth = truth.select(F.col("q_id").cast("string").alias("q_id"), F.col("vec_id").cast("string").alias("id"), "cos").persist()
    assert truth.count() == 10 * n
    probe = V.tune(index)
    found = V.search(index, queries, 10, probe)
    assert V.recall(found, truth) >= 0.9
    # these vectors lie in all directions alike, the worst case for cells; still a part of them is not read
    read = V.cells_read(index, queries, probe).agg(F.max("cells"), F.avg("members")).first()
    assert read[0] == probe < index.cells.count() and read[1] < 0.75 * n
    # one query reads the folders of its cells only
    one = queries.limit(1)
    cells = {r["cell"] for r in V._ranked(index, one, 3, beyond=False).collect()}
    files = index.members.where(F.col("cell").isin(*cells))
    scan = files._jdf.queryExecution().executedPlan().toString()
    assert len(cells) == 3 and "PartitionFilters: [cell" in scan
    truth.unpersist()


def test_few_cells_suffice_for_clusters(spark, tmp_path):
    from vitagraph.operators import vector_index as V

    x = clustered(np.random.default_rng(3), 1500, 16, 40)
    rows = table(spark, x)
    index = V.build(rows, f"file://{tmp_path}/cells", 40)
    probe = V.tune(index, 5)
    ids = range(0, 1500, 7)
    want = [(str(q), str(i), float(c)) for q, found in brute(x, 5, ids).items() for i, c in found]
    truth = spark.createDataFrame(want, "q_id string, id string, cos double")
    assert V.recall(V.search(index, asked(rows, ids), 5, probe), truth) >= 0.9
    assert V.cells_read(index, asked(rows, ids), probe).agg(F.avg("members")).first()[0] < 0.2 * 1500


def test_edges(spark, tmp_path):
    from vitagraph.operators import vector_index as V

    none = table(spark, [[1.0, 2.0]]).limit(0)
    index = V.build(none, f"file://{tmp_path}/none")
    assert V.search(index, none.select(F.col("id").alias("q_id"), F.col("v").alias("q")), 3).count() == 0
    zeros = table(spark, [[0.0, 0.0], [0.0, 0.0]])
    index = V.build(zeros, f"file://{tmp_path}/zeros")
    got = V.search(index, asked(zeros, [0]), 3, exact=True).collect()
    assert [(r["id"], r["cos"]) for r in got] == [("1", 0.0)]


def test_claims_are_retrieved_with_their_evidence(spark, tmp_path):
    from vitagraph.operators import search as S
    from vitagraph.operators import vector_index as V
    from vitagraph.plans import mapping as M

    g = M.graph(spark, "/root/testdata/sf0.001")
    index = V.index_claims(g, f"file://{tmp_path}/claims", 40)
    q = "the theory of order and reason"
    got = V.retrieve_claims(g, index, q, 8, exact=True).collect()
    want = S.search(g, q, 8, "claim").collect()
    assert len(got) == 8 and [r["rank"] for r in got] == list(range(1, 9))
    assert [r["cosine"] for r in got] == pytest.approx([r["score"] for r in want], abs=1.1e-4)
    assert all(r["subject_name"] and r["evidence_rows"] is None or r["evidence_rows"] for r in got)
