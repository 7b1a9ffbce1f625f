"""Fill-in-the-middle: documents cut in three and put together anew, with tables of units.

A text is a row of units (code points, or whatever a pattern matches from left to right).
Two draws for a document say after how many units its prefix and its middle end.  Where that
is in the text is found relationally:

* ``posexplode`` gives runs of adjacent units, each with its number of units and characters;
  a run of up to ``RUN`` units is one match and one row, so a text of n units has about
  n / RUN rows, and these have no text;
* window sums over a document's runs say behind how many units and characters each begins;
* cut requests, a row for each draw, join the run that holds the unit of that ordinal;
* the offsets that come out are aggregated to one row for each document, which is joined
  with its text, and ``substring`` cuts.

Texts are moved once, for that last join.  Rows of the same id and text have the same offsets,
so before it they are one document, aggregated where they are read: any number of repeated
rows is a row for each task, and the join, whose side of texts Spark may split, gives each its cuts.

The form follows from further draws: *plain* leaves a text as it is, *psm* gives prefix,
suffix, middle, *spm* suffix, prefix, middle, with a mark before each.  ``restore`` turns an
output back into its text; as a text that holds a mark stays plain, each mark stands in an
output once.

Edge cases: a null text is an empty one, which is plain; a null ``doc_id`` is drawn for as an
empty number; a text of one unit has an empty prefix, middle or suffix like any other; units
that don't cover a text, as their pattern leaves parts out, can't be cut apart without loss:
such a text is plain; very long texts are as many runs as they need; only ``doc_id`` and
``text`` are read, so further columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scoped

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units in one row at most; bounds the rows of a long text and the characters that are looked at again for a cut.
RUN = 2_000
#: A code point.
CODE_POINT = "(?s)."


@dataclass(frozen=True)
class Forms:
    """Draws are seeded; of 100 documents about ``plain`` stay, and of 100 others about ``spm`` have that form."""

    seed: int = 1
    plain: int = 10
    spm: int = 20


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _documents(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: the key stands for id and text."""
    text, number = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat_ws(":", number, text), 256), 1, 32))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))


def _drawn(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _n_units(text: Column, unit: str) -> Column:
    return F.length(text) if unit == CODE_POINT else F.size(_matches(text, unit))


def runs(docs: DataFrame, unit: str = CODE_POINT, forms: Forms = Forms()) -> DataFrame:
    """key, h1, h2, and for each run its ordinal (run), n_units and n_chars, the sums of both up to its end, and of the document.

    A run is a match of up to ``RUN`` units on end: the same units that ``unit`` matches one by one.
    """
    found = F.transform(
        _matches(F.col("text"), f"(?:{unit}){{1,{RUN}}}+"), lambda r: F.struct(_n_units(r, unit).cast("long").alias("units"), F.length(r).cast("long").alias("chars"))
    )
    h = [_draw(_drawn(forms.seed), k).alias(f"h{k}") for k in (1, 2)]
    each = _documents(docs).select("key", *h, F.posexplode(found).alias("run", "m"))
    # rows of one id and text are the same document
    each = each.groupBy("key", "run").agg(*[F.first(c).alias(c) for c in ("h1", "h2", "m")]).select("key", "h1", "h2", "run", "m.units", "m.chars")
    upto, whole = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("key")
    return each.select(
        "*",
        F.sum("units").over(upto).alias("upto_units"),
        F.sum("chars").over(upto).alias("upto_chars"),
        F.sum("units").over(whole).alias("n"),
        F.sum("chars").over(whole).alias("n_chars"),
    )


def offsets(docs: DataFrame, unit: str = CODE_POINT, forms: Forms = Forms()) -> DataFrame:
    """One row for each document that has units: key, n, n_chars and, for the ends of prefix (first)
    and middle (second), the units they lie behind, the place and length of the run that holds the
    last of these, and how many of its units come before the cut."""
    found = materialize(runs(docs, unit, forms), "unit-runs")
    drawn = found.where("run = 0").select("key", *[(F.col(h) % (F.col("n") + 1)).alias(h) for h in ("h1", "h2")])
    ends = F.array(F.struct(F.lit(1).alias("cut"), F.least("h1", "h2").alias("ordinal")), F.struct(F.lit(2).alias("cut"), F.greatest("h1", "h2").alias("ordinal")))
    requests = drawn.select("key", F.explode(ends).alias("r")).select("key", "r.cut", "r.ordinal")
    # a cut behind no unit at all is at the start of the first run
    holds = (F.col("ordinal") <= F.col("upto_units")) & ((F.col("ordinal") > F.col("upto_units") - F.col("units")) | ((F.col("ordinal") == 0) & (F.col("run") == 0)))
    met = found.join(requests, "key").where(holds)
    at = F.struct(
        "ordinal", (F.col("upto_chars") - F.col("chars")).alias("start"), F.col("chars"), (F.col("ordinal") - F.col("upto_units") + F.col("units")).alias("into")
    )
    return met.groupBy("key").agg(
        F.max("n").alias("n"), F.max("n_chars").alias("n_chars"), *[F.max(F.when(F.col("cut") == k, at)).alias(c) for k, c in ((1, "first"), (2, "second"))]
    )


def _place(at: Column, unit: str) -> Column:
    """Characters before a cut."""
    if unit == CODE_POINT:
        return at["start"] + at["into"]
    run = F.substring(F.col("text"), (at["start"] + 1).cast("int"), at["chars"].cast("int"))
    inside = F.slice(_matches(run, unit), F.lit(1), at["into"].cast("int"))
    return at["start"] + F.aggregate(inside, F.lit(0).cast("long"), lambda n, u: n + F.length(u))


def cut_documents(docs: DataFrame, unit: str = CODE_POINT, forms: Forms = Forms()) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output; a row for each row of ``docs``."""
    found = offsets(docs, unit, forms).withColumnRenamed("key", "_key").hint("shuffle_hash")
    every = _documents(docs).select("*", *[_draw(_drawn(forms.seed), k).alias(f"h{k}") for k in (3, 4)])
    both = every.join(found, F.col("key") == F.col("_key"), "left")
    marked = F.greatest(*[F.locate(m, F.col("text")) for m in (PREFIX, SUFFIX, MIDDLE)]) > 0
    plain = F.col("n").isNull() | (F.col("n_chars") != F.length("text")) | marked | (F.col("h3") % 100 >= 100 - forms.plain)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < forms.spm, "spm").otherwise("psm")
    a, b = (F.when(F.col("form") != "plain", _place(F.col(c), unit).cast("int")) for c in ("first", "second"))
    placed = both.withColumn("form", form).select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "form", a.alias("a"), b.alias("b"))
    parts = placed.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.substring("text", F.lit(1), F.col("a")).alias("prefix"),
        F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        F.substring("text", F.col("b") + 1, F.length("text")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text from which an output was made, from the output and its form alone."""

    def between(mark: str, end: str | None) -> Column:
        start = F.locate(mark, output) + len(mark)
        stop = F.length(output) + 1 if end is None else F.locate(end, output)
        return F.substring(output, start, stop - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@scoped("middle-digests")
def digest_documents(docs: DataFrame, unit: str = CODE_POINT, forms: Forms = Forms()) -> DataFrame:
    """Lengths of the parts, and digests of the output and of the text restored from it."""
    made = cut_documents(docs, unit, forms)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
