"""Shortest connecting path between two nodes over claims as undirected edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..graph import Graph
from ..runtime import discard, in_order, materialize, scoped


@dataclass(frozen=True)
class Path:
    from_id: str | None
    to_id: str | None
    found: bool
    length: int
    #: (step, from, from_name, from_type, relationship, direction, forward, claim, certainty, status, sources,
    #: to, to_name, to_type), or None.
    steps: DataFrame | None


def adjacency(g: Graph) -> DataFrame:
    """Both directions of every claim whose ends are known; ``eo`` orders a node's edges."""
    known = g.node.select(F.col("id").alias("_n"))
    claims = g.claim.select("ord", "id", "subject", "object")
    for c in ("subject", "object"):
        claims = claims.join(known, F.col(c) == F.col("_n"), "left_semi")
    ahead = claims.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "id", F.lit(True).alias("forward"), (F.col("ord") * 2).alias("eo"))
    back = claims.select(F.col("object").alias("src"), F.col("subject").alias("dst"), "id", F.lit(False).alias("forward"), (F.col("ord") * 2 + 1).alias("eo"))
    return ahead.unionByName(back)


def shortest_path(g: Graph, from_id: str, to_id: str, max_hops: int | None = 6) -> Path:
    """Breadth-first search, one join for each hop.

    A hop takes each new node by its least (place of the frontier node, place of the edge);
    that pair also gives the node its own place in the next frontier.  Every level is
    written to the shared folder, so plans stay small and nothing is recomputed.
    """
    hops = max(1, min(12, 6 if max_hops is None else int(max_hops)))
    present = {r["id"] for r in g.node.where(F.col("id").isin(from_id, to_id)).select("id").collect()}
    a, b = (from_id if from_id in present else None), (to_id if to_id in present else None)
    if a is None or b is None:
        return Path(a, b, False, 0, None)
    if a == b:
        return Path(a, b, True, 0, None)
    written: list[DataFrame] = []
    try:
        chain = _walk(g, from_id, to_id, hops, written)
    finally:
        discard(*written)
    if chain is None:
        return Path(a, b, False, 0, None)
    return Path(a, b, True, len(chain), _steps(g, chain))


def _walk(g: Graph, from_id: str, to_id: str, hops: int, written: list[DataFrame]) -> list[tuple] | None:
    """(step, from, claim, forward, to) of the path from its end; tables that it writes are noted."""
    def keep(df: DataFrame, label: str) -> DataFrame:
        written.append(materialize(df, label))
        return written[-1]

    spark = g.node.sparkSession
    edges = keep(adjacency(g), "path-edges")
    frontier = spark.createDataFrame([(from_id,)], "id string").select(
        "id", F.lit(0).cast("long").alias("rank"), *[F.lit(None).cast(t).alias(n) for n, t in (("prev", "string"), ("claim", "string"), ("forward", "boolean"))]
    )
    visited, levels = frontier.select("id"), []
    for _ in range(hops):
        step = frontier.select(F.col("id").alias("f_id"), "rank").join(edges, F.col("f_id") == F.col("src"))
        step = step.join(visited.select(F.col("id").alias("_v")), F.col("dst") == F.col("_v"), "left_anti")
        first = step.groupBy("dst").agg(
            F.min_by(F.struct("src", "id", "forward"), F.struct("rank", "eo")).alias("w"), F.min(F.struct("rank", "eo")).alias("k")
        )
        level = keep(
            first.select(F.col("dst").alias("id"), "k", F.col("w.src").alias("prev"), F.col("w.id").alias("claim"), F.col("w.forward").alias("forward")),
            "path-level",
        )
        size = level.agg(F.count("*").alias("n"), F.count_if(F.col("id") == to_id).alias("hit")).first()
        if size["n"] == 0:
            return None
        levels.append(level)
        if size["hit"]:
            break
        visited = visited.unionByName(level.select("id"))
        # a global order of the new nodes: by (place, edge), ranked range by range
        frontier = keep(in_order(level.select("id", "k"), F.col("k"), name="rank"), "path-rank").select("id", "rank")
    else:
        return None
    # walk back: one row for each level
    chain, at = [], to_id
    for n in range(len(levels), 0, -1):
        row = levels[n - 1].where(F.col("id") == at).select("prev", "claim", "forward").first()
        chain.append((n, row["prev"], row["claim"], row["forward"], at))
        at = row["prev"]
    return chain


def _steps(g: Graph, chain: list[tuple]) -> DataFrame:
    steps = g.node.sparkSession.createDataFrame(chain, "step int, `from` string, claim string, forward boolean, `to` string")
    info = g.claim.select(F.col("id").alias("_id"), F.col("type").alias("relationship"), "direction", "certainty", "status")
    keys = F.broadcast(steps.select(F.col("claim").alias("_k")))  # at most 12 claims
    info = info.join(keys, F.col("_id") == F.col("_k"), "left_semi")
    per = quality.evidence_per_claim(g.listed.join(keys, F.col("claim") == F.col("_k"), "left_semi"), g.evidence)
    out = steps.join(info, F.col("claim") == F.col("_id")).join(per.select(F.col("claim").alias("_c"), "sources"), F.col("claim") == F.col("_c"), "left")
    ends = F.broadcast(steps.select(F.explode(F.array("from", "to")).alias("_k")).distinct())
    names = g.node.join(ends, F.col("id") == F.col("_k"), "left_semi")
    for end in ("from", "to"):
        out = out.join(names.select(F.col("id").alias("_n"), F.col("name").alias(f"{end}_name"), F.col("type").alias(f"{end}_type")), F.col(end) == F.col("_n")).drop("_n")
    return out.select(
        "step", "from", "from_name", "from_type", "relationship", "direction", "forward", "claim", "certainty", "status",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "to", "to_name", "to_type",
    )


@scoped("distances")
def distances(g: Graph, from_id: str, max_hops: int = 6) -> DataFrame:
    """id, hops: nodes within ``max_hops`` of a node."""
    edges = materialize(adjacency(g).select("src", "dst").distinct(), "distances-edges")
    seen = g.node.where(F.col("id") == from_id).select("id", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.select(F.col("id").alias("f_id")).join(edges, F.col("f_id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)), "distances")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
