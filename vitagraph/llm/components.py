"""Connected components of links between long ids, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (columns a, b); component is the least id reachable.

    Rounds of two steps until nothing changes.  Large star: each node points its larger
    neighbours to its least neighbour.  Small star: each node points its smaller neighbours
    and itself to the least of them.  Every round halves distances or better, so the number
    of rounds grows with the logarithm of a component's diameter.  A node with very many
    links is never gathered: least neighbours come from partially aggregated minima, and
    go back to the links by a join whose large side Spark may split.
    """
    now = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        )
        last, now = now, materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        discard(last)
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == state:
            break
        state = new
    # every node but the least of its component now has one link, to that least one
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
