"""CSV imports and SQL or Parquet exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import multi, sql_quote
from ..graph import Graph

NODE_COLUMNS = ("id", "type", "name", "domains", "external_ids", "description")
CLAIM_COLUMNS = ("id", "type", "subject", "object", "population", "direction", "certainty", "status", "source_id", "study_design", "quote")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: all cells are trimmed strings, missing ones are empty, blank rows go.

    Quoted cells may hold commas, line breaks and doubled quotes; surplus cells are dropped; of columns
    with the same name the last counts.  ``row`` numbers the rows within each file in order.
    """
    opts = {"header": False, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    head = spark.read.options(**opts).csv(path).limit(1).first()
    if head is None:
        return spark.createDataFrame([], T.StructType([T.StructField("row", T.LongType())]))
    names = [(c or "").strip() for c in head]
    to = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = spark.read.schema(to).options(**{**opts, "header": True, "enforceSchema": True}).csv(path)
    last = {n: i for i, n in enumerate(names) if n}
    cell = lambda i: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"c{i}"), F.lit("")), r"\r\n?", "\n"), r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")
    full = reduce(lambda a, b: a | b, [cell(i) != "" for i in range(len(names))])
    # one file is one partition when it is read across lines, and ids grow with the place in it
    return rows.where(full).select(F.monotonically_increasing_id().alias("row"), *[cell(i).alias(n) for n, i in last.items()])


def _cell(df: DataFrame, name: str) -> Column:
    c = F.col(name) if name in df.columns else F.lit("")
    return F.when(c != "", c)


def node_inputs(rows: DataFrame) -> DataFrame:
    return rows.select(
        "row", *[_cell(rows, c).alias(c) for c in ("id", "type", "name", "description")], *[multi(_cell(rows, c)).alias(c) for c in ("domains", "external_ids")]
    )


def claim_inputs(rows: DataFrame) -> DataFrame:
    """Claims of a CSV; one evidence record where there is a source, curated unless stated."""
    from ..operators.writes import EVIDENCE_INPUT

    plain = ("id", "type", "subject", "object", "population", "direction", "certainty")
    record = F.struct(
        _cell(rows, "source_id").alias("source_id"), F.lit(None).cast("string").alias("source_node"), _cell(rows, "quote").alias("quote"),
        _cell(rows, "study_design").alias("study_design"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("extracted_by"),
    )
    none = F.array().cast(EVIDENCE_INPUT)
    evidence = F.when(_cell(rows, "source_id").isNotNull(), F.array(record)).otherwise(none)
    absent = [F.lit(None).cast("string").alias(c) for c in ("mechanism", "setting", "rec_strength")]
    return rows.select(
        "row", *[_cell(rows, c).alias(c) for c in plain], F.coalesce(_cell(rows, "status"), F.lit("curated")).alias("status"), *absent, evidence.alias("evidence")
    )


def import_csv(g: Graph, spark: SparkSession, path: str, kind: str) -> tuple[Graph, DataFrame]:
    from ..operators.writes import import_batch

    rows = read_csv(spark, path)
    if kind == "nodes":
        return import_batch(g, nodes=node_inputs(rows))
    if kind == "claims":
        return import_batch(g, claims=claim_inputs(rows))
    raise ValueError(f"unknown kind: {kind}")


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement for each row, as a text column ``value``: ready for ``write.text``."""

    def literal(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            items = F.array_join(F.transform(c, lambda x: sql_quote(x.cast("string"))), ",")
            return F.when(c.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("ARRAY["), items, F.lit("]")))
        if isinstance(f.dataType, T.NumericType | T.BooleanType):
            return F.coalesce(c.cast("string"), F.lit("NULL"))
        return sql_quote(c.cast("string"))

    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *map(literal, df.schema.fields)), F.lit(");")).alias("value"))


def graph_statements(g: Graph) -> DataFrame:
    """All tables of a graph as statements, in the order in which they can be run (column ``part``)."""
    out = [insert_statements(getattr(g, t), t).withColumn("part", F.lit(i)) for i, t in enumerate(("node", "claim", "evidence", "relation"))]
    return reduce(DataFrame.unionByName, out)
