"""A training-data pipeline over ``documents``: five stages, each on all that its predecessor kept.

1. quality rules: documents that fail the base rules or the compression bands go;
2. n-gram Jaccard join: of each group of near copies the least document stays;
3. secret scans: credentials that are no widely copied examples are masked in the text;
4. mixing: sources are taken to their target weights, documents repeated as often as they
   are taken, in the order of their training positions;
5. encoding: token counts and digests of every document that training sees.

All stages but the last return the columns of ``documents``, further ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitagraph.llm import compression_bands, curriculum_mix, jaccard_pivots, piece_codec, secret_scan
from vitagraph.llm.common import discard, read, scoped

#: SQL has no zstandard, so the rows of ``run`` are tested against a brute-force version.
ORACLE_SQL = None
#: Near copies here: sets of five-word shingles that are at least this similar (per cent).
SHINGLE_WORDS, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts fail; repeated rows are judged alike; very long texts are measured whole."""
    return compression_bands.filter_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The keeper of each group: the row of the least id, null ids last.

    Of rows that equal it in id and text one stays, whichever has the least hash over all columns.
    Texts without words link with nothing, so each such (id, text) stays.
    """
    groups = jaccard_pivots.join(docs, SHINGLE_WORDS, SIMILAR)
    keepers = groups.select("keeper.doc_id", "keeper.txt").distinct()
    keepers = keepers.select(F.col("doc_id").alias("_kid"), F.coalesce("txt", F.lit(b"")).alias("_ktxt"))
    names = docs.columns
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("_txt"),
    )
    kept = row.join(keepers, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_txt") == F.col("_ktxt")), "left_semi")
    one = kept.groupBy("_id", "_txt").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in names])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null, texts without a secret as they are; ``n_chars`` follows a text that changes."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source of its own; documents without words are never taken; see ``curriculum_mix``."""
    return curriculum_mix.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of ``docs``; a null text is encoded as an empty one."""
    return piece_codec.digest_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written, and what the stage wrote and read on the way is deleted."""
    docs, (*stages, (_, last)) = read(spark, sf_dir, "documents"), STAGES
    for number, (_, stage) in enumerate(stages, 1):
        before, docs = docs, scoped(f"pipeline-{number}")(stage)(spark, docs, sf_dir)
        if number > 1:
            discard(before)
    return last(spark, docs, sf_dir)
