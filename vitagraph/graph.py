"""A graph as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema


def conform(df: DataFrame, to: T.StructType) -> DataFrame:
    """Columns of ``to``, in order and type; missing ones are null, lists are never null."""
    out = []
    for f in to.fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


@dataclass(frozen=True)
class Graph:
    node: DataFrame
    claim: DataFrame
    evidence: DataFrame
    listed: DataFrame
    relation: DataFrame
    vocab: DataFrame

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


def vocabulary(spark: SparkSession, lists: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(name, i, v) for name, values in (lists or schema.VOCABULARIES).items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, schema.VOCAB)


def listed_from(evidence: DataFrame) -> DataFrame:
    return conform(evidence.select("claim", "ev_ord", F.col("id").alias("evidence")), schema.LISTED)


def build(spark: SparkSession, node, claim, evidence, relation, listed=None, vocab=None) -> Graph:
    """A graph from tables that may lack optional columns."""
    evidence = conform(evidence, schema.EVIDENCE)
    return Graph(
        conform(node, schema.NODE),
        conform(claim, schema.CLAIM),
        evidence,
        listed_from(evidence) if listed is None else conform(listed, schema.LISTED),
        conform(relation, schema.RELATION),
        vocabulary(spark) if vocab is None else vocab,
    )


def save(g: Graph, path: str) -> None:
    for name in ("node", "claim", "evidence", "listed", "relation", "vocab"):
        getattr(g, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, **plans: DataFrame) -> Graph:
    """``plans``: tables that are not there."""
    table = lambda name, to: plans[name] if name in plans else spark.read.schema(to).parquet(f"{path}/{name}")
    return Graph(
        table("node", schema.NODE),
        table("claim", schema.CLAIM),
        table("evidence", schema.EVIDENCE),
        table("listed", schema.LISTED),
        table("relation", schema.RELATION),
        table("vocab", schema.VOCAB),
    )
