"""Writes of evidence and updates, imports, papers, prompts, gap questions, seeds' lists, pages of lists."""

import json
import shutil

from pyspark.sql import functions as F
from test_graph import g  # noqa: F401

from vitagraph.functions import text


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_evidence_is_written_and_deleted(spark, g):  # noqa: F811
    from vitagraph.operators import writes as W

    rows = spark.createDataFrame(
        [(1, "n1", "c1", "PMID:9", "rct"), (2, "n2", "c1", "nothing", None), (3, "n3", "zz", "PMID:9", None), (4, "n1", "c1", "PMID:9", None), (5, "n5", "c1", "PMID:9", "odd"), (6, "e1", "c1", "PMID:3", None), (7, "n7", "c1", "PMID:7", None)],
        "row int, id string, claim string, source_id string, study_design string",
    )
    after, checked = W.create_evidence(g, rows)
    assert {r["row"]: r["status_code"] for r in checked.collect()} == {1: 200, 2: 400, 3: 400, 4: 409, 5: 400, 6: 409, 7: 200}
    last = max(r["ev_ord"] for r in g.evidence.where("claim = 'c1'").collect())
    assert {r["id"]: r["ev_ord"] for r in after.evidence.where("id like 'n%'").collect()} == {"n1": last + 1, "n7": last + 2}
    assert after.listed.count() == g.listed.count() + 2
    gone = W.delete_evidence(after, ["n1", "e1"])
    assert {r["id"] for r in after.evidence.collect()} - {r["id"] for r in gone.evidence.collect()} == {"n1", "e1"}
    assert gone.listed.where("evidence in ('n1', 'e1')").count() == 0


def test_updates_overwrite(spark, g):  # noqa: F811
    from vitagraph.operators import writes as W

    nodes = spark.createDataFrame([(1, "o:fall", "outcome", "Falls"), (2, "none", "outcome", "x"), (3, "o:mood", "odd", "x")], "row int, id string, type string, name string")
    after, checked = W.update_nodes(g, nodes)
    assert {r["row"]: r["status_code"] for r in checked.collect()} == {1: 200, 2: 404, 3: 400}
    row = after.node.where("id = 'o:fall'").first()
    assert row["name"] == "Falls" and row["domains"] == [] and row["ord"] == g.node.where("id = 'o:fall'").first()["ord"]
    claims = spark.createDataFrame([(1, "c1", "improves", "i:walk", "o:mood", "curated"), (2, "zz", "improves", "i:walk", "o:mood", "curated"), (3, "c2", "improves", "zz", "o:mood", "curated")], "row int, id string, type string, subject string, object string, status string")
    full = claims.select("*", *[F.lit(None).cast("string").alias(c) for c in ("direction", "certainty", "setting", "rec_strength", "population", "mechanism")])
    after, checked = W.update_claims(g, full)
    assert {r["row"]: r["status_code"] for r in checked.collect()} == {1: 200, 2: 404, 3: 400}
    row = after.claim.where("id = 'c1'").first()
    assert (row["type"], row["object"], row["certainty"]) == ("improves", "o:mood", None) and after.claim.count() == g.claim.count()


def test_csv_import(spark, g, tmp_path):  # noqa: F811
    from vitagraph.operators.writes import import_counts
    from vitagraph.sources import tabular

    (tmp_path / "nodes.csv").write_text('id,type,name\nn:a,drug,"Name, with comma"\nn:b,odd,Name\nn:a,drug,again\n')
    after, results = tabular.import_csv(g, spark, f"{tmp_path}/nodes.csv", "nodes")
    assert tuple(import_counts(results).first()) == (1, 2)
    row = after.node.where("id = 'n:a'").first()
    assert row["name"] == "Name, with comma" and row["type"] == "drug"
    (tmp_path / "claims.csv").write_text("id,type,subject,object,status,source_id,quote,study_design\nk1,improves,i:walk,o:mood,curated,PMID:5,a quote,rct\nk2,improves,i:walk,o:mood,curated,,,\n")
    after, results = tabular.import_csv(g, spark, f"{tmp_path}/claims.csv", "claims")
    assert {r["id"]: r["ok"] for r in results.collect()} == {"k1": True, "k2": False}
    ev = after.evidence.where("claim = 'k1'").first()
    assert (ev["source_id"], ev["study_design"]) == ("PMID:5", "rct")
    statements = [r["value"] for r in tabular.graph_statements(after).orderBy("part").collect()]
    assert statements[0].startswith("INSERT INTO node") and any("'k1'" in s and s.startswith("INSERT INTO claim") for s in statements)


def test_papers(spark, g):  # noqa: F811
    from vitagraph.operators.writes import enrich
    from vitagraph.sources.pages import source_meta

    wanted = spark.createDataFrame([("PMID:1",), ("PMID:2",), ("DOI:10.1/X",), ("https://a.b",), ("PMID:x",), ("odd",)], "source_id string")
    record = "found boolean, title string, journal string, year string, authors array<string>, pubtypes array<string>, type string"
    pubmed = spark.createDataFrame([("1", True, "A trial", "J", "2020 May", ["A", "B", "C", "D"], ["Randomized Controlled Trial"], None)], f"pmid string, {record}")
    crossref = spark.createDataFrame([("10.1/x", True, "Another work", None, "1999", None, [], "journal-article")], f"doi string, {record}")
    meta = source_meta(wanted, pubmed, crossref)
    got = {r["source_id"]: r for r in meta.collect()}
    assert {s: (r["exists"], r["lookup_failed"]) for s, r in got.items()} == {"PMID:1": (True, False), "PMID:2": (False, True), "DOI:10.1/X": (True, False), "https://a.b": (True, False), "PMID:x": (False, False), "odd": (False, False)}
    assert got["PMID:1"]["year"] == "2020" and got["PMID:1"]["study_design"] == "rct"
    papers = {r["id"]: r for r in text.paper_node(meta).collect()}
    assert papers["pmid:1"]["description"] == "J · 2020 · A, B, C" and papers["pmid:1"]["external_ids"] == ["PMID:1"]
    after = enrich(g, meta)
    assert after.node.count() == g.node.count() + 2
    ev = {r["id"]: r for r in after.evidence.collect()}
    assert ev["e1"]["source_node"] == "pmid:1" and ev["e1"]["study_design"] == "rct" and ev["e5"]["study_design"] == "guideline"


def test_gap_questions(spark):
    from vitagraph import schema
    from vitagraph.operators.review import process_gaps

    log = spark.createDataFrame(
        [(i, f"q{i}", i != 4, 0 if i != 5 else 3, "rejected" if i == 6 else None) for i in range(1, 8)], "id long, question string, ok boolean, num_claims int, gap_status string"
    ).withColumn("created_at", F.timestamp_seconds("id"))
    topics = spark.createDataFrame([("t:known-topic-of-old", "Known topic of old", "done", 0, 0)], "id string, topic string, status string, priority int, attempts int")
    d = schema.DOMAINS[0]
    judged = [(1, True, "A new topic to study", d), (2, True, "A new topic, to study", d), (3, False, "Irrelevant but long", d), (7, True, "Known topic of old", d)]
    after, queue, decided = process_gaps(log, topics, spark.createDataFrame(judged, "id long, relevant boolean, topic string, domain string"))
    got = {r["id"]: r["gap_status"] for r in after.collect()}
    # the newer of two questions on one topic queues it
    assert got == {1: "rejected", 2: "queued", 3: "rejected", 4: None, 5: None, 6: "rejected", 7: "rejected"}
    new = queue.where("status = 'pending'").collect()
    assert [(r["topic"], r["priority"]) for r in new] == [("A new topic, to study", 5)] and decided.count() == 4


def test_prompts(spark, g):  # noqa: F811
    from vitagraph.operators import agents as A

    nodes = g.node.where("id in ('i:walk', 'g:gap')")
    got = {r["key"]: r["prompt"] for r in A.term_prompts(nodes).collect()}
    assert "Walking (outdoor) (exercise)" in got["i:walk"] and "Also called: Brisk walks" in got["i:walk"] and "Description: Nothing is known" in got["g:gap"]
    match = spark.createDataFrame([("k", "Walking", "exercise", "MESH:D1", "Walk")], "key string, name string, type string, curie string, label string")
    assert "MESH:D1 Walk" in A.verify_prompts(match).first()["prompt"]
    papers = spark.createDataFrame([("p", "Title", "x" * 7000), ("q", None, None)], "id string, title string, abstract string")
    got = {r["key"]: r["prompt"] for r in A.extraction_prompts(papers, ["a", "b"]).collect()}
    assert got["p"].count("x") == 6000 and got["q"].startswith("Known concepts:\na\nb")
    judged = {r["key"]: r["prompt"] for r in A.judge_prompts(g, g.claim.where("id = 'c1'")).collect()}
    assert "PMID:1 (rct)" in judged["c1"]
    said = spark.createDataFrame([("c1", 'So: {"verdict": "approve", "certainty": "high"}'), ("c2", '{"verdict": "?", "certainty": "odd"}'), ("c3", "no")], "key string, reply string")
    assert {r["claim"]: (r["verdict"], r["certainty"]) for r in A.verdicts(said).collect()} == {"c1": ("approve", "high"), "c2": ("refine", None)}
    families = ("big-4", "small-1")
    for model, want in (("big-4", True), ("big-4-20250101", True), ("big-45", False), (None, False)):
        assert one(spark, A.model_in(F.lit(model).cast("string"), families)) is want
    used = A.replies(papers.select(F.col("id").alias("key"), F.lit("p").alias("prompt")), None)
    assert used.count() == 2 and tuple(A.usage(used).first()) == (0, 0)


def test_badges_and_listings(spark, g):  # noqa: F811
    from vitagraph.operators import review as R

    checks = lambda ok: json.dumps({"citations": [{"source_id": "PMID:1", "resolved": ok}, {"source_id": "PMID:2", "resolved": True}]})
    runs = spark.createDataFrame([(1, "reviewer", "c1", checks(True), 1), (2, "reviewer", "c1", checks(False), 2), (3, "curator", "c1", checks(True), 3)], "id long, agent string, claim_id string, summary string, at long")
    runs = runs.withColumn("created_at", F.timestamp_seconds("at"))
    got = {r["id"]: r["resolved"] for r in R.evidence_badges(g.evidence, runs).collect()}
    assert got["e1"] is False and got["e2"] is True and got["e4"] is None and len(got) == g.evidence.count()
    rows = spark.range(23)
    part, at, done = R.cursor(rows, ["id"], 20, 10, 5)
    assert [r["id"] for r in part.collect()] == [20, 21, 22] and (at, done) == (23, True)
    part, at, done = R.cursor(rows, ["id"], -4, 100, 5)
    assert [r["id"] for r in part.collect()] == list(range(5)) and (at, done) == (5, False)
    log = spark.range(60).withColumn("created_at", F.timestamp_seconds("id"))
    assert [r["id"] for r in R.newest(log, 3).collect()] == [59, 58, 57] and R.newest(log).count() == 50


def test_vectors_and_labels(spark):
    array = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, text.l2_normalize(array(3.0, 4.0))) == [0.6, 0.8] and one(spark, text.l2_normalize(array(0.0, 0.0))) == [0.0, 0.0]
    assert one(spark, text.accept_label(array("Falls, accidental"), array("x", "falls accidental"))) is True
    assert one(spark, text.accept_label(array("Falls"), array("fall"))) is False


def test_documents_by_kind(spark):
    from vitagraph.sources.pages import documents

    words = "The committee recommends regular exercise, as it lowers the risk. " * 5
    rows = [("a.html", f"<body><p>{words}</p></body>".encode(), "text/html"), ("b.pdf", b"no pdf at all", None), ("c", b"%PDF", "application/pdf"), ("d", None, None)]
    got = {r["path"]: (r["kind"], r["text"]) for r in documents(spark.createDataFrame(rows, "path string, content binary, content_type string")).collect()}
    assert got["a.html"] == ("html", words.strip()) and got["b.pdf"] == ("pdf", None) and got["c"][0] == "pdf" and got["d"] == ("html", None)


def test_lists_of_seeds(spark, tmp_path):
    from vitagraph.sources.seed import load_list

    (tmp_path / "t.json").write_text(json.dumps({"topics": [{"topic": "one", "priority": 2}, {"topic": " "}, {"priority": 1}, {"topic": "two"}]}))
    got = load_list(spark, f"{tmp_path}/t.json", "topics", "topic: string, priority: int", "topic").orderBy("ord").collect()
    assert [(r["ord"], r["topic"], r["priority"]) for r in got] == [(0, "one", 2), (3, "two", None)]


def test_a_replaced_table_gives_a_new_graph(spark, tmp_path):
    from vitagraph.plans import mapping as M
    from vitagraph.runtime import exists

    folder = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", folder, copy_function=shutil.copyfile)
    folder.chmod(0o755)
    first = M.graph(spark, str(folder))
    n = first.node.count()
    key = (spark.sparkContext.applicationId, str(folder))
    old = M._built[key][1]
    assert M.graph(spark, str(folder)).node.inputFiles() == first.node.inputFiles()
    regions = spark.read.parquet(f"{folder}/region.parquet").toPandas()
    regions.iloc[:2].to_parquet(folder / "region.parquet")
    assert M.graph(spark, str(folder)).node.count() == n - 3
    assert not exists(spark, old)
    M._forget(key)
    assert key not in M._built
