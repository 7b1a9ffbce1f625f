"""What a prompt can hold: lines chosen in a total order until a budget of characters is full.

The running sum that decides is worked out in parts: rows are dealt by ranges of (prompt, order), each range
sums what it has, and from these sums, a row for each range and prompt, each range knows what lies
before it.  A range beyond the budget drops all its rows at once; no task sees all rows of a prompt.
Only ids and sizes are dealt, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import materialize
from .answers import named
from .search import candidate_pool


def within_budget(rows: DataFrame, budget: int, *order: Column) -> DataFrame:
    """Rows (key, size, ...) of each key, in the order given, as long as the sum of sizes is ``budget`` at most; ``upto`` is that sum.

    The order should leave no ties.  Rows of a null key are a prompt of their own; null sizes count as 0, and
    the first row that is too large ends its prompt, whatever comes after.
    """
    rows = rows.withColumn("size", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")))
    dealt = rows.repartitionByRange(F.col("key"), *order).sortWithinPartitions(F.col("key"), *order).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "dealt-lines")
    sums = dealt.groupBy("key", "_p").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_before") <= budget)
    sums = sums.select(F.col("key").alias("_k"), F.col("_p").alias("_q"), "_before")
    local = Window.partitionBy("_p", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.join(sums, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_q")))
    near = near.withColumn("upto", F.sum("size").over(local) + F.col("_before"))
    return near.where(F.col("upto") <= budget).drop("_p", "_k", "_q", "_before")


def node_lines(g: Graph, budget: int) -> DataFrame:
    """key (type), id, line, upto: the nodes that a prompt about their type lists, by name."""
    lines = g.node.select(F.col("type").alias("key"), "id", "name", F.concat("id", F.lit(" ("), "type", F.lit("): "), "name").alias("line"))
    chosen = within_budget(lines.select("key", "id", "name", (F.length("line") + 1).alias("size")), budget, F.col("name"), F.col("id"))
    chosen = chosen.select("id", "upto").withColumnRenamed("id", "_id")
    return lines.join(chosen, F.col("id") == F.col("_id")).select("key", "id", "line", "upto")


def claim_lines(g: Graph, claims: DataFrame) -> DataFrame:
    """ord, id, line: a claim in a line, as a catalogue lists it."""
    rows = claims.select("ord", "id", "type", "subject", "object", "population", "direction", "certainty")
    for c in ("subject", "object", "population"):
        rows = named(rows, g.node, c, f"_{c}")
    part = lambda before, c, after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    line = F.concat(
        "id", F.lit(" | "), "_subject", F.lit(" — "), F.replace("type", F.lit("_"), F.lit(" ")), part(" (", F.col("direction"), ")"), F.lit(" → "), "_object",
        part(" · in ", F.col("_population")), part(" · ", F.col("certainty")),
    )
    return rows.select("ord", "id", line.alias("line"))


def catalogue(g: Graph, budget: int, claims: DataFrame | None = None) -> DataFrame:
    """One row (catalogue, n): the lines of the pool's claims, in their order, that fit into ``budget`` characters."""
    lines = claim_lines(g, candidate_pool(g) if claims is None else claims)
    sizes = lines.select(F.lit("").alias("key"), "ord", "id", (F.length("line") + 1).alias("size"))
    chosen = within_budget(sizes, budget, F.col("ord"), F.col("id")).select(F.col("id").alias("_id"))
    rows = lines.join(chosen, F.col("id") == F.col("_id"))  # as many as fit
    every = F.array_sort(F.collect_list(F.struct("ord", "id", "line")))
    return rows.agg(every.alias("c"), F.count("*").alias("n")).select(F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("catalogue"), "n")
