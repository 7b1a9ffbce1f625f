"""Seeds through the data source: rows as by ``load_graph``, filters that the reader takes."""

import json

import pytest


def write(path, **lists):
    path.write_text(json.dumps({"version": 3, **lists}))


SEED = {
    "nodes": [{"id": "a", "type": "drug", "name": "A"}, {"id": "b", "type": "scale", "name": "B", "aliases": ["x", "y"]}, {"id": "a", "type": "drug", "name": "A again"}],
    "claims": [{"id": "c1", "type": "improves", "subject": "a", "object": "b", "evidence": ["e2", "e1"], "effect_value": 2}, {"id": "c2", "type": "worsens", "subject": "a", "object": "b"}],
    "evidence": [{"id": "e1", "claim": "c1", "source_id": "PMID:1", "confidence": 0.5}, {"id": "e2", "claim": "c1", "source_id": "PMID:2"}],
    "contradictions": [{"id": "r1", "type": "contradicts", "subject_claim": "c1", "object_claim": "c2"}, {"id": "r2", "type": "refines", "subject_claim": "c1", "object_claim": "c2"}],
}


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_rows_as_load_graph(spark, tmp_path):
    from vitagraph.sources.seed import load_graph
    from vitagraph.sources.seed_source import load_seeds

    write(tmp_path / "s.json", **SEED)
    want, got = load_graph(spark, f"{tmp_path}/s.json"), load_seeds(spark, f"{tmp_path}/s.json")
    for table in ("node", "claim", "evidence", "listed", "relation", "vocab"):
        assert rows(getattr(got, table)) == rows(getattr(want, table)), table


def test_filters_are_taken_by_the_reader(spark, tmp_path):
    from vitagraph.sources.seed_source import seed_table

    write(tmp_path / "a.json", **SEED)
    write(tmp_path / "b.json", nodes=[{"id": "z", "type": "drug", "name": None}, 3, None])
    (tmp_path / "_hidden").write_text("no seed")
    found = seed_table(spark, f"{tmp_path}", "nodes")
    assert found.rdd.getNumPartitions() == 2
    drugs = found.where("type = 'drug'")
    plan = drugs._jdf.queryExecution().executedPlan().toString()
    # the comparison has gone into the scan; only the test for null stays above it
    assert "= drug" not in plan and "BatchScan graph_seed" in plan
    assert [(r["ord"], r["id"]) for r in drugs.orderBy("ord").collect()] == [(0, "a"), (2, "a"), (1 << 32, "z")]
    assert seed_table(spark, f"{tmp_path}", "contradictions").where("type = 'contradicts'").count() == 1
    assert found.where("type in ('scale', 'tool') and name like 'B%'").count() == 1
    assert found.where("name is null").count() == 1 and found.where("type = 'x'").count() == 0
    with pytest.raises(Exception, match="no such table"):
        seed_table(spark, f"{tmp_path}", "odd").count()


def test_edges(spark, tmp_path):
    from vitagraph.sources.seed_source import load_seeds, seed_table

    (tmp_path / "empty").mkdir()
    assert seed_table(spark, f"file://{tmp_path}/empty", "nodes").count() == 0
    write(tmp_path / "bad.json", nodes=[{"id": 7}])
    with pytest.raises(Exception, match="id is 7"):
        seed_table(spark, f"{tmp_path}/bad.json", "nodes").collect()
    write(tmp_path / "none.json")
    assert load_seeds(spark, f"{tmp_path}/none.json").claim.count() == 0
    with pytest.raises(Exception, match="gone"):
        seed_table(spark, f"{tmp_path}/gone", "nodes").count()


def test_written_seeds_come_back_from_files_of_bounded_size(spark, tmp_path):
    from pyspark.sql import functions as F

    from vitagraph.sources.seed import load_graph
    from vitagraph.sources.seed_source import load_seeds, write_seeds

    more = [{"id": f"n{k}", "type": "drug", "name": f'A "name"\n{k}'} for k in range(500)]
    write(tmp_path / "s.json", **{**SEED, "nodes": SEED["nodes"] + more})
    g = load_graph(spark, f"{tmp_path}/s.json")
    write_seeds(g, f"{tmp_path}/out", 2, most=50)
    written = [p.read_text() for p in (tmp_path / "out").rglob("part-*")]
    sizes = [sum(len(json.loads(t)[k]) for k in SEED) for t in written]
    assert sum(sizes) == g.node.count() + 6 and len(written) > 8 and max(sizes) < 100
    assert max(len(line) for t in written for line in t.splitlines()) < 1000  # an entry is a line: no task puts a file together
    again = load_seeds(spark, f"{tmp_path}/out")
    for table in ("node", "claim", "evidence", "listed", "relation"):
        plain = lambda x: getattr(x, table).drop("ord", "ev_ord")  # noqa: B023, E731
        assert rows(plain(again)) == rows(plain(g)), table
    write_seeds(g.with_(**{t: getattr(g, t).where(F.lit(False)) for t in ("node", "claim", "evidence", "listed", "relation")}), f"{tmp_path}/none", 2)
    assert load_seeds(spark, f"{tmp_path}/none").node.count() == 0
