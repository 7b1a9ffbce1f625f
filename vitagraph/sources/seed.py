"""Seed files: a JSON graph, JSON vocabularies, JSON lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..graph import Graph, conform, vocabulary

_S = T.StringType()
_LIST = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


GRAPH_FILE = _struct(
    version=T.LongType(),
    nodes=T.ArrayType(_struct(id=_S, type=_S, name=_S, description=_S, aliases=_LIST, domains=_LIST, external_ids=_LIST)),
    claims=T.ArrayType(
        _struct(
            id=_S, type=_S, subject=_S, object=_S, population=_S, mechanism=_S, setting=_S, direction=_S, certainty=_S, status=_S,
            rec_strength=_S, dose=_S, comparator=_S, effect_measure=_S, effect_value=T.DoubleType(), effect_note=_S, evidence=_LIST,
        )
    ),
    evidence=T.ArrayType(
        _struct(id=_S, claim=_S, source_id=_S, source_node=_S, quote=_S, study_design=_S, confidence=T.DoubleType(), extracted_by=_S)
    ),
    contradictions=T.ArrayType(_struct(id=_S, type=_S, subject_claim=_S, object_claim=_S)),
)
VOCAB_FILE = _struct(**{name: _LIST for name in schema.VOCABULARIES})


def _entries(raw: DataFrame, field: str) -> DataFrame:
    """Entries with ``ord``; of equal ids the last content stands at the first place."""
    rows = raw.select(F.posexplode(field).alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e")
    best = rows.groupBy(F.col("e.id").alias("_id")).agg(F.min("ord").alias("ord"), F.max_by("e", "ord").alias("e"))
    return best.select("ord", "e.*")


def load_graph(spark: SparkSession, graph_file: str, vocab_file: str | None = None) -> Graph:
    """A graph from its JSON files, read with explicit schemas."""
    raw = spark.read.schema(GRAPH_FILE).option("multiLine", True).json(graph_file)
    claims = _entries(raw, "claims")
    listed = claims.select(F.col("id").alias("claim"), F.posexplode("evidence").alias("ev_ord", "evidence"))
    evidence = _entries(raw, "evidence")
    place = listed.groupBy("evidence").agg(F.min("ev_ord").alias("ev_ord"))
    evidence = evidence.drop("ord").join(place, F.col("id") == F.col("evidence"), "left").drop("evidence")
    return Graph(
        conform(_entries(raw, "nodes"), schema.NODE),
        conform(claims.drop("evidence"), schema.CLAIM),
        conform(evidence, schema.EVIDENCE),
        conform(listed, schema.LISTED),
        conform(_entries(raw, "contradictions"), schema.RELATION),
        vocabulary(spark) if vocab_file is None else load_vocabulary(spark, vocab_file),
    )


def load_vocabulary(spark: SparkSession, vocab_file: str) -> DataFrame:
    raw = spark.read.schema(VOCAB_FILE).option("multiLine", True).json(vocab_file)
    each = F.array(*[F.struct(F.lit(n).alias("vocab"), F.col(n).alias("v")) for n in VOCAB_FILE.names])
    rows = raw.select(F.explode(each).alias("x")).select("x.vocab", F.posexplode("x.v").alias("ordinal", "value"))
    return conform(rows, schema.VOCAB)


def seed_version(spark: SparkSession, graph_file: str) -> int | None:
    row = spark.read.schema(GRAPH_FILE).option("multiLine", True).json(graph_file).select("version").first()
    return row["version"] if row else None


def provision(spark: SparkSession, stored: Graph | None, settings: DataFrame, graph_file: str, force: bool = False) -> tuple[Graph, DataFrame]:
    """The graph and settings after provisioning: the seed is loaded when its version is not the stored one."""
    from ..operators.writes import get_setting, load_seed, set_setting

    version = seed_version(spark, graph_file)
    if stored is not None and not force and get_setting(settings, "version") == str(version):
        return stored, settings
    seed = load_graph(spark, graph_file)
    fresh = seed if stored is None or force else load_seed(stored, seed)
    return fresh, set_setting(settings, "version", str(version))


def load_list(spark: SparkSession, file: str, field: str, columns: str, required: str) -> DataFrame:
    """Entries of a JSON list (topics, guidelines, priorities) with ``ord``; those without ``required`` are dropped."""
    raw = spark.read.schema(f"`{field}` array<struct<{columns}>>").option("multiLine", True).json(file)
    rows = raw.select(F.posexplode(field).alias("ord", "e")).select("ord", "e.*")
    return rows.where(F.coalesce(F.trim(required), F.lit("")) != "")
