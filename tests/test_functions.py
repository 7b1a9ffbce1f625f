"""Functions on single values."""

import random

from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def fnv(s):
    h = 2166136261
    for u in s.encode("utf-16-be")[::1] and [int.from_bytes(s.encode("utf-16-be")[i : i + 2], "big") for i in range(0, 2 * len(s), 2)]:
        h = ((h ^ u) * 16777619) & 0xFFFFFFFF
    return h


def test_hash(spark):
    from vitagraph.functions import text as X

    for s in ("", "exercise", "naïve ü", "a|b|c"):
        assert one(spark, X.fnv32(F.lit(s))) == fnv(s)
    assert one(spark, X.ascii_hash(F.lit("exercise"))) == 4117174779


def test_names(spark):
    from vitagraph.functions import text as X
    from vitagraph.runtime import ship

    ship(spark)
    for given, want in (("Exercise (physical activity)", "exercise"), ("Risk of Falls", "risk falls"), ("Vitamin-D", "vitamin d"), ("naïve", "nai ve"), (None, "")):
        assert one(spark, X.canonical(F.lit(given).cast("string"))) == want
    assert one(spark, X.token_set(F.lit("activities falls glass bus"))) == ["activity", "fall", "glass", "bus"]
    assert one(spark, X.de_paren(F.lit("Fall rate (accidental falls) x"))) == "Fall rate x"
    assert one(spark, X.name_variants(F.lit("Fall rate (accidental falls)"), F.array(F.lit("Falls 10"), F.lit("fall-RATE")))) == [
        "Fall rate (accidental falls)", "Fall rate", "accidental falls", "Falls 10",
    ]
    assert one(spark, X.search_terms(F.lit("A (b)"), F.array(F.lit("c"), F.lit("d")))) == ["A", "A (b)", "c"]
    assert one(spark, X.merge_codes(F.array(F.lit(" MESH:D10 ")), F.array(F.lit("MESH:D10"), F.lit("HP:1")))) == ["MESH:D10", "HP:1"]
    assert one(spark, X.topic_id(F.lit("Vitamin D & falls"))) == "t:vitamin-d-falls"
    assert one(spark, X.node_id(F.lit("!!"))) == "ga:node"


def test_identifiers(spark):
    from vitagraph.functions import text as X

    kinds = {"PMID:1": "PMID", "doi:10.1/x": "DOI", "https://a": "URL", "x": "OTHER"}
    for k, v in kinds.items():
        assert one(spark, X.citation_kind(F.lit(k))) == v
    for k, v in {"123": "PMID:123", " 10.1234/x": "DOI:10.1234/x", "10.1/x": "10.1/x", "pmid:4": "pmid:4"}.items():
        assert one(spark, X.normalize_source_id(F.lit(k))) == v
    assert one(spark, X.guideline_source_id(F.lit("https://doi.org/10.1/a"), F.lit(None).cast("string"))) == "DOI:10.1/a"
    assert one(spark, X.guideline_source_id(F.lit(""), F.lit("https://a"))) == "URL:https://a"
    assert one(spark, X.code_url(F.lit("mesh:D 1"))) == "https://meshb.nlm.nih.gov/record/ui?ui=D%201"
    assert one(spark, X.code_url(F.lit("PMID:7"))) == "https://pubmed.ncbi.nlm.nih.gov/7/"
    assert one(spark, X.code_url(F.lit("XX:7"))) is None and one(spark, X.code_url(F.lit("nothing"))) is None
    assert one(spark, X.cited_ids(F.lit("a [PMID: 12] b [doi:10.1/x] [PMID:12] PMID: 9"))) == ["PMID:12", "doi:10.1/x"]


def test_quality_parts(spark):
    from vitagraph.functions import quality as Q

    for text, want in (("n = 1,234", 1234), ("12,345 participants and n=50", 12345), ("none", None), (None, None)):
        assert one(spark, Q.sample_size(F.lit(text).cast("string"))) == want


def test_documents(spark):
    from vitagraph.functions import text as X
    from vitagraph.sources import pages

    html = "<html><head><title>t</title></head><body><script>x</script><p>Some <b>bold</b>\n text</p></body></html>"
    assert one(spark, X.html_to_text(F.lit(html))) == "Some bold text"
    long = "<body><nav><a href='#'>menu menu menu menu</a></nav><p>" + "word " * 60 + "</p></body>"
    assert one(spark, pages.page_text(F.lit(long))).startswith("word word")
    assert "menu" not in one(spark, pages.page_text(F.lit(long)))
    assert one(spark, X.study_design(F.array(F.lit("Randomized Controlled Trial")), F.lit("x"), F.lit(None).cast("string"))) == "rct"
    assert one(spark, X.study_design(F.array().cast("array<string>"), F.lit("A cohort of men"), F.lit(None).cast("string"))) == "cohort"
    for given, want in (('say ```json\n{"a": "}"}``` ok', '{"a": "}"}'), ("none", None), ('[1, {"b": 2}] x', '[1, {"b": 2}]')):
        assert one(spark, X.extract_json(F.lit(given))) == want


def test_csv(spark, tmp_path):
    from vitagraph.sources.tabular import insert_statements, node_inputs, read_csv

    f = tmp_path / "n.csv"
    f.write_text('id,type,name,domains\n n1 ,tool,"A, ""b""\nc",x; y|z\n,,,\nn2,tool\n')
    rows = read_csv(spark, str(f)).orderBy("row").collect()
    assert [r["id"] for r in rows] == ["n1", "n2"]
    assert rows[0]["name"] == 'A, "b"\nc' and rows[1]["domains"] == ""
    made = node_inputs(read_csv(spark, str(f))).orderBy("row").collect()
    assert made[0]["domains"] == ["x", "y", "z"] and made[1]["name"] is None
    df = spark.createDataFrame([("o'x", 1, ["a"], None)], "s string, n int, l array<string>, z string")
    assert insert_statements(df, "t").first()["value"] == "INSERT INTO t (s, n, l, z) VALUES ('o''x', 1, ARRAY['a'], NULL);"


def test_parsers(spark):
    from vitagraph.sources import pages as P

    rows = lambda body: spark.createDataFrame([("Ann Lee", body)], "term string, body string")
    ols = P.parse_ols(rows('{"response":{"docs":[{"obo_id":"HP:1","label":"Fall","synonym":["Tumble"]},{"obo_id":"GO:1","label":"x"}]}}'), "HP").collect()
    assert [(r["curie"], r["labels"]) for r in ols] == [("HP:1", ["Fall", "Tumble"])]
    assert [r["curie"] for r in P.parse_mesh(rows('[{"resource":"http://x/mesh/D5","label":"L"},{"label":"no"}]')).collect()] == ["MESH:D5"]
    assert [r["curie"] for r in P.parse_rxnorm(rows('{"idGroup":{"rxnormId":["9"]}}')).collect()] == ["RXNORM:9"]
    assert [r["curie"] for r in P.parse_ror(rows('{"items":[{"id":"https://ror.org/0a","name":"U"}]}')).collect()] == ["ROR:0a"]
    person = '{"orcid-id":"1","given-names":"Ann","family-names":"Lee"}'
    assert P.parse_orcid(rows('{"expanded-result":[%s]}' % person)).count() == 1
    assert P.parse_orcid(rows('{"expanded-result":[%s,%s]}' % (person, person))).count() == 0


def test_rate_limit(spark):
    from vitagraph.streaming.limits import limited

    rng = random.Random(3)
    events = [(rng.choice("ab"), i, rng.randrange(0, 5000)) for i in range(200)]
    got = {r["seq"]: r["accepted"] for r in limited(spark.createDataFrame(events, "key string, seq int, at_ms long"), 3, 400).collect()}
    kept = {}
    for k, seq, at in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        ok = sum(at - t < 400 for t in kept.setdefault(k, [])) < 3
        if ok:
            kept[k].append(at)
        assert got[seq] == ok


def test_seed_files(spark, tmp_path):
    from vitagraph.sources.seed import load_graph, provision

    f = tmp_path / "graph.json"
    f.write_text(
        '{"version": 3, "nodes": [{"id": "a", "type": "tool", "name": "old"}, {"id": "b", "type": "tool", "name": "B"}, {"id": "a", "type": "tool", "name": "new"}],'
        ' "claims": [{"id": "c", "type": "is_a", "subject": "a", "object": "b", "status": "curated", "evidence": ["e2", "e1", "gone"]}],'
        ' "evidence": [{"id": "e1", "claim": "c", "source_id": "PMID:1"}, {"id": "e2", "claim": "c", "source_id": "PMID:2"}], "contradictions": []}'
    )
    g = load_graph(spark, str(f))
    assert [(r["ord"], r["id"], r["name"]) for r in g.node.orderBy("ord").collect()] == [(0, "a", "new"), (1, "b", "B")]
    assert [r["evidence"] for r in g.listed.orderBy("ev_ord").collect()] == ["e2", "e1", "gone"]
    settings = spark.createDataFrame([], "key string, value string")
    fresh, settings = provision(spark, None, settings, str(f))
    again, _ = provision(spark, fresh, settings, str(f))
    assert again is fresh


def test_stream(spark, tmp_path):
    from vitagraph import schema
    from vitagraph.streaming.limits import keep_current, tail

    rows = spark.createDataFrame([(1, "q")], "id long, question string")
    from vitagraph.graph import conform

    conform(rows, schema.ASK_LOG).write.parquet(str(tmp_path / "log"))
    got = []
    keep_current(tail(spark, str(tmp_path / "log"), schema.ASK_LOG), lambda df: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [r["question"] for r in got] == ["q"]


def test_canonical_names_read_whole_texts(spark, tmp_path):
    from vitagraph.plans.contract import QUERIES

    texts = ["The first line\nand a second (dropped)\n\nThird, too", "(an opening\nparenthesis) kept", "\nstarts empty", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["canon"], r["topic_id"]) for r in QUERIES["canonical_names"](spark, str(tmp_path)).collect()}
    assert got == {
        0: ("first line second third too", "t:the-first-line-and-a-second-dropped-third-too"),
        1: ("kept", "t:an-opening-parenthesis-kept"),
        2: ("starts empty", "t:starts-empty"),
        3: ("", "t:x"),
    }
