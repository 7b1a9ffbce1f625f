"""Fill-in-the-middle: against plain slicing, for code points and for other units."""

import hashlib
import random
import re

import pytest
from helpers import AWKWARD, docs, nullified


def plain(doc_id, text, unit, forms):
    """(n, form, prefix, middle, suffix, output) by Python's own slices."""
    text = text or ""
    units = re.findall(unit, text, re.ASCII)  # as in Java
    n = len(units)
    digest = hashlib.sha256(f"{forms.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not n or "".join(units) != text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - forms.plain:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < forms.spm:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


MARKED = ["with <P> in it", "<S>", "end <M>", "broken < P> <S <M", "<P", "<", "M>", "a<<<S"]


@pytest.mark.parametrize(("unit", "run"), [("(?s).", 3), ("(?s).", 2_000), (r"\S+\s*|\s+", 3), ("[a-z]+", 2_000)])
def test_against_slices(spark, monkeypatch, unit, run):
    from pyspark.sql import functions as F

    from vitagraph.llm import middle_cut

    monkeypatch.setattr(middle_cut, "RUN", run)
    rng = random.Random(run)
    texts = ["".join(rng.choice("ab \n<PSM>é😀") for _ in range(rng.randrange(30))) for _ in range(150)]
    awkward = [t and t[:3_000] for t in AWKWARD] if run == 3 else AWKWARD
    texts += ["abc", "abcdef", "aaaa"] * 12 + MARKED + awkward + ["same"] * 3
    df = nullified(docs(spark, texts))
    df = df.unionByName(df.where("doc_id < 20"))  # repeated rows
    forms = middle_cut.Forms(seed=7, plain=20, spm=40)
    made = middle_cut.cut_documents(df, unit, forms).withColumn("back", middle_cut.restore(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(texts) + 21
    seen = set()
    for r in made:
        text = None if r["doc_id"] is None else texts[r["doc_id"]]
        assert tuple(r)[1:7] == plain(r["doc_id"], text, unit, forms), text
        assert r["back"] == (text or "")
        seen.add(r["form"])
    assert seen == {"plain", "psm", "spm"}
    assert middle_cut.digest_documents(df.limit(0), unit, forms).count() == 0


def test_query_against_its_sql(spark):
    import duckdb

    from vitagraph.llm.queries import OP13_SQL, op13_middle_cut

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    df = op13_middle_cut(spark, data)
    cur = con.execute(OP13_SQL)
    assert df.columns == [c[0] for c in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_one_document_a_third_of_all_rows(spark):
    from vitagraph.llm.middle_cut import digest_documents, runs

    texts = ["a copied text"] * 400 + [f"text {i}" for i in range(800)]
    df = docs(spark, texts).selectExpr("if(text = 'a copied text', 0, doc_id) AS doc_id", "text")
    # the copies are one document until the texts come in
    assert runs(df).count() == 801
    got = digest_documents(df).collect()
    assert len(got) == 1200 and len({tuple(r) for r in got if r["doc_id"] == 0}) == 1
