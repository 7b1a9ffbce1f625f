"""Nearest vectors from an inverted file: vectors lie in cells around trained centres, and a search
reads the cells that are likely to hold its answer, or all that can.

Cells are trained by k-means on a sample of the unit vectors whose size is bounded by parameters;
every vector is then assigned to its nearest centre and written to its cell's folder, so that a
cell that is not asked for is not read.  A search ranks cells by their centres, compares its
query with the members of the first ``probe`` cells in double precision, and is done: that is
the approximate mode.  How many cells that takes depends on the vectors: a few where they lie in
clusters, half of them where they lie in all directions alike; ``tune`` measures it, and ``recall``
the outcome.  The exact mode goes on: a
member's angle to its centre is at most the cell's radius, so by the triangle inequality no member
can be closer to a query than the angle between query and centre less the radius.  Cells
that can still hold one of the k nearest are read too, all others are known to hold none.

Bounds: at most ``MAX_CELLS`` centres are kept in memory, in the driver and by tasks; members of a large
cell and the queries that ask for it are dealt into blocks, so no task holds a cell.

Edge cases: null vectors, vectors with null or non-finite components or of another length than the
index has are not indexed and find nothing; a zero vector has cosine 0 to all, and lies in a cell of
its own; a query's own id is no answer to it; equal cosines go by id; an empty table has no cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import ship
from .search import corpus, embeddings, hydrate

#: Most centres of an index, and sampled vectors for each of them.
MAX_CELLS, SAMPLE = 4_096, 64
#: Members and queries that meet in one task at a time.
MEMBER_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Cosines come rounded to this many places.
PLACES = 6
#: The cell of zero vectors.
NOWHERE = -1


def _usable(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of an array column without nulls; zero rows stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(top == 0, 1.0, top)  # else squares of very small or large components are lost
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def _rows(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32), matrix.ravel())


@dataclass(frozen=True)
class CellIndex:
    """``centers`` by cell; ``cells``: cell, n, radius (an angle); ``members``: id, v (unit), by cell."""

    spark: SparkSession
    path: str
    dim: int

    @property
    def members(self) -> DataFrame:
        return self.spark.read.schema("id string, v array<double>, angle double, cell int").parquet(f"{self.path}/members")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.schema("cell int, center array<double>, n bigint, radius double").parquet(f"{self.path}/cells")


def _train(units: DataFrame, n_cells: int, seed: int) -> np.ndarray:
    """Unit centres of k-means on a sample by hash, of about ``SAMPLE`` vectors a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = units.count()
    share = min(1.0, SAMPLE * n_cells / max(n, 1))
    part = units.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000)))
    part = part.select(array_to_vector("v").alias("features")).persist()
    try:
        model = KMeans(k=n_cells, maxIter=10, seed=seed).fit(part)
    finally:
        part.unpersist()
    centers = np.array(model.clusterCenters())
    norm = np.linalg.norm(centers, axis=1)
    return centers[norm > 0] / norm[norm > 0][:, None]


def build(vectors: DataFrame, path: str, n_cells: int | None = None, seed: int = 1) -> CellIndex:
    """Write the index of ``vectors`` (id, v) to a folder.  The length of vectors is that of most of them.

    Without ``n_cells`` there are about as many cells as the square root of the vectors' number.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<double>").alias("v"))
    lengths = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count()
    most = lengths.orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 0
    rows = rows.where(_usable(F.col("v"), dim))
    cells = n_cells or max(1, math.isqrt(most["count"]) if most else 1)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _rows(_matrix(batch.column(1), dim))], names=["id", "v"])

    units = rows.mapInArrow(unit, "id string, v array<double>")
    some = units.where(F.exists("v", lambda x: x != 0))
    centers = np.zeros((0, dim)) if some.isEmpty() else _train(some, min(cells, MAX_CELLS), seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            cell, angle = np.full(len(x), NOWHERE, np.int32), np.zeros(len(x))
            some = np.flatnonzero(x.any(axis=1))
            if len(some):
                cos = x[some] @ centers.T
                cell[some] = cos.argmax(axis=1)
                angle[some] = np.arccos(np.clip(cos.max(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), _rows(x), pa.array(angle), pa.array(cell)], names=["id", "v", "angle", "cell"])

    placed = rows.mapInArrow(assign, "id string, v array<double>, angle double, cell int")
    # a hot cell is written by several tasks
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/members")
    index = CellIndex(spark, path, dim)
    named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)] + [(NOWHERE, [0.0] * dim)], "_cell int, center array<double>")
    sizes = index.members.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    found = sizes.join(F.broadcast(named), F.col("cell") == F.col("_cell")).select("cell", "center", "n", "radius")
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # at most MAX_CELLS + 1 rows
    return index


def _ranked(index: CellIndex, queries: DataFrame, probe: int, beyond: bool) -> DataFrame:
    """q_id, q (unit), cell, rank: the first ``probe`` cells of each query, or those after them that can hold one as near as its ``least``."""
    table = index.cells.orderBy("cell").collect()  # at most MAX_CELLS + 1
    cells = np.array([r["cell"] for r in table], np.int32)
    centers, radius, dim = np.array([r["center"] for r in table]).reshape(len(table), index.dim), np.array([r["radius"] for r in table]), index.dim
    zero = cells == NOWHERE

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column(1), dim)
                cos = np.clip(q @ centers.T, -1.0, 1.0)
                order = np.argsort(-cos, axis=1, kind="stable")
                ranks = np.empty_like(order)
                np.put_along_axis(ranks, order, np.arange(len(cells))[None, :], axis=1)
                take = ranks < probe
                if beyond:
                    bound = np.cos(np.maximum(0.0, np.arccos(cos) - radius))
                    bound[:, zero] = 0.0
                    bound[~q.any(axis=1)] = 0.0
                    least = part.column(2).to_numpy(zero_copy_only=False)
                    take = ~take & (bound >= least[:, None] - 2 * 10.0**-PLACES)
                m, n = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(m)), _rows(q).take(pa.array(m)), pa.array(cells[n]), pa.array(ranks[m, n])], names=["q_id", "q", "cell", "rank"])

    return queries.mapInArrow(rank, "q_id string, q array<double>, cell int, rank bigint")


def _meet(index: CellIndex, asked: DataFrame, k: int) -> DataFrame:
    """q_id, id, cos of queries (q_id, q, cell) and the members of their cells; by block the k best and what ties with them."""
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_CELLS + 1
    spark, dim = asked.sparkSession, index.dim
    sizes = {r["cell"]: r["n"] for r in index.cells.where(F.col("cell").isin(*wanted)).select("cell", "n").collect()}
    plan = [(c, max(1, -(-n // MEMBER_BLOCK)), max(1, -(-wanted[c] // QUERY_BLOCK))) for c, n in sizes.items()]
    dealt = F.broadcast(spark.createDataFrame(plan, "cell int, slots int, blocks int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(dealt, "cell").select("cell", upto("slots").alias("slot"), F.pmod(F.xxhash64("q_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), F.col("q_id").alias("id"), F.col("q").alias("v"))
    members = index.members.where(F.col("cell").isin(*wanted))  # folders of other cells are not read
    right = members.join(dealt, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot"), upto("blocks").alias("block"), F.lit(1).alias("side"), "id", "v")
    keys = ["cell", "slot", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in (*keys, "side")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                here, part = tuple(marks[:3, a]), batch.slice(a, b - a)
                if here != key:
                    key, held = here, []
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if marks[3, a] == 0:
                    held.append((part.column("id"), x))
                    continue
                for ids, q in held:
                    cos = q @ x.T
                    kth = max(0, cos.shape[1] - k - 1)  # one more, as a query may meet itself
                    least = np.partition(cos, kth, axis=1)[:, kth] - 2 * 10.0**-PLACES
                    m, n = np.nonzero(cos >= least[:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(m)), part.column("id").take(pa.array(n)), pa.array(cos[m, n])], names=["q_id", "id", "cos"])

    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side")
    found = both.mapInArrow(run, "q_id string, id string, cos double").where("q_id <> id")
    return found.withColumn("cos", F.round("cos", PLACES))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("cos"), F.length("id"), "id"))
    return found.withColumn("rk", rank).where(F.col("rk") <= k)


def search(index: CellIndex, queries: DataFrame, k: int, probe: int = 8, exact: bool = False) -> DataFrame:
    """q_id, id, cos, rk: the k nearest to each query (q_id, q) among the members of the cells that are read.

    Ids are strings; of equal cosines the shorter id comes first, then the lesser, which is the order of numbers.
    """
    ship(queries.sparkSession)
    rows = queries.select(F.col("q_id").cast("string").alias("q_id"), F.col("q").cast("array<double>").alias("q")).where(_usable(F.col("q"), index.dim))
    first = _meet(index, _ranked(index, rows, probe, beyond=False), k)
    if not exact:
        return _best(first, k)
    from ..runtime import materialize

    first = materialize(_best(first, k), "nearest-in-cells")
    # the cosine that a further answer must have; none yet, if there are fewer than k
    least = first.where(F.col("rk") == k).select(F.col("q_id").alias("_q"), F.col("cos").alias("least"))
    asked = rows.join(least, F.col("q_id") == F.col("_q"), "left").select("q_id", "q", F.coalesce("least", F.lit(-2.0)).alias("least"))
    more = materialize(_ranked(index, asked, probe, beyond=True), "further-cells")
    return _best(first.drop("rk").unionByName(_meet(index, more, k)), k)


def cells_read(index: CellIndex, queries: DataFrame, probe: int = 8) -> DataFrame:
    """q_id, cells, members that the approximate search of each query reads."""
    rows = queries.select(F.col("q_id").cast("string").alias("q_id"), F.col("q").cast("array<double>").alias("q")).where(_usable(F.col("q"), index.dim))
    asked = _ranked(index, rows, probe, beyond=False).join(F.broadcast(index.cells.select("cell", "n")), "cell")
    return asked.groupBy("q_id").agg(F.count("*").alias("cells"), F.sum("n").alias("members"))


def tune(index: CellIndex, k: int = 10, target: float = 0.93, sample: int = 256) -> int:
    """How many cells to probe so that about ``target`` of the k nearest are found, as measured on about ``sample`` members.

    The truth is the exact mode's; what counts is where a true answer's cell stands in its query's order of cells.
    """
    n = index.members.count()
    if not n:
        return 1
    some = index.members.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < math.ceil(min(1.0, sample / n) * 1_000_000))
    queries = some.select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    truth = search(index, queries, k, exact=True).select("q_id", "id")
    place = truth.join(index.members.select("id", "cell"), "id").select("q_id", "cell")
    ranks = _ranked(index, queries, MAX_CELLS + 1, beyond=False).select("q_id", "cell", "rank")
    counts = place.join(ranks, ["q_id", "cell"]).groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").collect()  # a row for each cell at most
    due, seen = target * sum(r["n"] for r in counts), 0
    for r in counts:
        seen += r["n"]
        if seen >= due:
            return r["rank"] + 1
    return 1


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of ``truth`` (q_id, id, cos) that ``found`` has; an answer of an equal cosine counts as the same."""
    least = truth.groupBy("q_id").agg(F.min("cos").alias("least"), F.count("*").alias("n"))
    hits = found.join(least, "q_id").where(F.col("cos") >= F.col("least")).groupBy("q_id").agg(F.count("*").alias("hits"))
    row = least.join(hits, "q_id", "left").agg(F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")).alias("hits"), F.sum("n").alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


# --- the graph's claims --------------------------------------------------------


def index_claims(g: Graph, path: str, n_cells: int | None = None) -> CellIndex:
    rows = corpus(g).where("owner_type = 'claim'")
    return build(embeddings(rows).select(F.col("owner_id").alias("id"), F.col("vector").alias("v")), path, n_cells)


def retrieve_claims(g: Graph, index: CellIndex, q: str, k: int = 8, probe: int = 8, exact: bool = False) -> DataFrame:
    """The k claims nearest to a question, hydrated, with ``cosine`` and ``rank``."""
    one = g.claim.sparkSession.createDataFrame([("", "", q)], "owner_type string, owner_id string, text string")
    asked = embeddings(one).select(F.lit("").alias("q_id"), F.col("vector").alias("q"))
    best = search(index, asked, k, probe, exact).select(F.col("id").alias("_i"), F.round("cos", 4).alias("cosine"), F.col("rk").alias("rank"))
    claims = g.claim.join(F.broadcast(best), F.col("id") == F.col("_i")).drop("_i")  # k rows
    cosines = claims.select(F.col("id").alias("_s"), "cosine")
    return hydrate(g, claims.drop("cosine")).join(cosines, F.col("id") == F.col("_s")).drop("_s").orderBy("rank")
