"""Embedding near-duplicates: cross-polytope hashing with multiprobe buckets and verified pairs.

A rotation (three rounds of random signs and a fast Hadamard transform) is followed by the
nearest vertex of the cross-polytope: the coordinate of largest magnitude, and its sign.
Several such hashes joined make the bucket of a table; a vector stands in its own bucket
and is also sent to the buckets that were nearly chosen (probes).

Exact copies (equal label and components) are one class; only classes are compared, in two
steps.  First a bucket gets 128 signs of random projections of each vector, not the vector,
and keeps those with a partner that differs in ``NEAR_BITS`` signs at most: a pair at the
threshold does in all but about two cases of a million.  Then the few that are kept bring their
vectors, and are compared by cosine in double precision, in blocks.

A pair can meet in several tables; every meeting place knows all bucket codes of both, so a
pair is counted only at its first one, and no list of pairs is ever made: a block reports
how many links each member has there, and a spanning forest of them.  A bucket with more
rows than ``BLOCK`` skips the first step and is cut into blocks, and each pair of blocks is a
group of its own, so large groups of near copies neither fill a task nor lose a pair.

The number of hashes in a table follows the size of the label, so that buckets keep about
``BUCKET`` vectors at most; tables double and probes grow by one with each further hash, to
keep recall (measured in the tests for several dimensions; 0.9 is the least asked for).

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component,
and vectors with a null label, link with nothing; vectors of different lengths don't link;
repeated rows are copies of each other, each linked with the others; a null vec_id takes
part and is never the smallest id of a component unless all are null; only the three
columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, arrow_map, materialize, scoped, ship, whole_groups
from .components import components

THRESHOLD = 0.93
BUCKET = 256
BLOCK = 4096
#: Tables and probes for one hash a table.
TABLES = 3
PROBES = 3
#: Signs in which a pair at the threshold differs: 15.4 of 128 on average, with a deviation of 3.7.
NEAR_BITS = 34
#: Groups up to this size are compared many at a time.
SMALL = 32
#: Sizes of labels, and buckets above ``BLOCK``, are broadcast up to this number; more are joined by shuffle.
BROADCAST_ROWS = 100_000
SEED = 20240501


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def codes(x: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """Bucket codes, shape (rows, tables, probes); the first probe is the row's own bucket, -1 is none."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    rng = np.random.default_rng(SEED + d)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        choice, gap = [], []  # by hash: the vertices in order of nearness, and how much is lost by each
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            top = min(d, probes + 1)
            near = np.argsort(-size, axis=1, kind="stable")[:, :top]
            vertex = 2 * near + (np.take_along_axis(y, near, 1) < 0)
            mags = np.take_along_axis(size, near, 1)
            choice.append(vertex)
            gap.append(mags[:, :1] - mags)
        own = np.zeros(n, np.int64)
        for v in choice:
            own = own * (2 * d) + v[:, 0]
        out[:, t, 0] = own
        # probes: one hash moved to a later vertex, least loss first
        place = [(2 * d) ** (hashes - 1 - h) for h in range(hashes)]
        alternatives = np.concatenate([g[:, 1:] for g in gap], axis=1)
        moved = np.concatenate([own[:, None] + (v[:, 1:] - v[:, :1]) * p for v, p in zip(choice, place, strict=True)], axis=1)
        best = np.argsort(alternatives, axis=1, kind="stable")[:, : probes - 1]
        picked = np.take_along_axis(moved, best, 1)
        out[:, t, 1 : 1 + picked.shape[1]] = picked
        if picked.shape[1] < probes - 1:
            out[:, t, 1 + picked.shape[1] :] = -1
    return out


def shape_for(size: int, dim: int = 64) -> tuple[int, int, int]:
    """(hashes, tables, probes) for the number of vectors of a label."""
    vertices = 2 << max(1, (dim - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(1.0, size / BUCKET)) / math.log(vertices)))
    return hashes, TABLES << (hashes - 1), PROBES + hashes - 1


def signs(x: np.ndarray) -> np.ndarray:
    """Signs of 128 random projections of the rows, as two 64-bit numbers."""
    g = np.random.default_rng(SEED + x.shape[1]).normal(size=(x.shape[1], 128))
    return np.packbits(x @ g > 0, axis=1).view(np.int64)


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, key (of equal vectors), vec (bytes of floats, of doubles where floats lose; null if the row can't link)."""

    def make():
        def step(columns: list[list]) -> list[list]:
            out: list[list] = [columns[0], columns[1], [], [], []]
            for label, v in zip(columns[1], columns[2], strict=True):
                good = bool(v) and label is not None and None not in v
                if good:
                    a = np.array(v, np.float64)
                    good = bool(np.isfinite(a).all()) and bool(a.any())
                data = None
                if good:
                    with np.errstate(over="ignore"):
                        short = a.astype(np.float32)
                    data = (short if (short == a).all() else a).tobytes()
                out[2].append(len(v) if good else None)
                out[3].append(hashlib.blake2b(data, digest_size=16).digest() if good else None)
                out[4].append(data)
            return out

        return step

    return arrow_map(
        vectors,
        [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e")],
        "vec_id bigint, label bigint, dim int, key binary, vec binary",
        make,
    )


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of large components overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs(starts: np.ndarray, n: int, own: np.ndarray, near, near_all, width: int = 1):
    """Pairs of rows (arrays a, b) that stand in one group and are near, one of the two at least in its own bucket.

    ``near(a, b)`` judges rows pair by pair, ``near_all(a, b)`` each of a with each of b.  Groups up
    to ``SMALL`` rows are compared together: each row with the next, the one after that, and so on.
    ``width`` is the number of values a row brings; it bounds how many pairs are judged at a time.
    """
    step = max(1, (1 << 20) // width)
    ends = np.append(starts[1:], n)
    sizes = ends - starts
    end_of = np.repeat(np.where(sizes <= SMALL, ends, starts), sizes)
    a = np.arange(n)
    for shift in range(1, SMALL):
        a = a[a + shift < end_of[a]]
        if not len(a):
            break
        for at in range(0, len(a), step):
            p = a[at : at + step]
            p = p[own[p] | own[p + shift]]
            p = p[near(p, p + shift)]
            yield p, p + shift
    for g in np.flatnonzero(sizes > SMALL).tolist():
        rows = np.arange(starts[g], ends[g])
        of = rows[own[rows]]
        for at in range(0, len(of), 512):
            r = of[at : at + 512]
            p, q = np.nonzero(near_all(r, rows))
            p, q = r[p], rows[q]
            keep = (p != q) & ~(own[q] & (p > q))
            yield p[keep], q[keep]


def _likely(part: pa.Table, starts: list[int]) -> np.ndarray:
    """Rows of groups (place) that have a partner whose signs are near."""
    s0, s1 = part.column("s0").to_numpy().view(np.uint64), part.column("s1").to_numpy().view(np.uint64)
    own = part.column("spot").to_numpy() >= 0

    def near(a, b):
        return np.bitwise_count(s0[a] ^ s0[b]) + np.bitwise_count(s1[a] ^ s1[b]) <= NEAR_BITS

    some = np.zeros(len(s0), bool)
    for a, b in _pairs(np.asarray(starts), len(s0), own, near, lambda a, b: near(a[:, None], b[None, :])):
        some[a] = True
        some[b] = True
    return np.flatnonzero(some)


def _meetings(part: pa.Table, starts: list[int]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Link counts by row, forest edges (rows), and the ids of groups of one dimension and number of hashes."""
    dim, tables, probes = (part.column(k)[0].as_py() for k in ("dim", "tables", "probes"))
    cid, spot, home, twins = (part.column(k).to_numpy() for k in ("cid", "spot", "home", "copies"))
    place, split = np.abs(spot) // probes, (part.column("i").to_numpy() != part.column("j").to_numpy())
    n = len(cid)
    x = unit(part.column("vec").to_pylist(), dim)
    c = part.column("codes").combine_chunks().flatten().to_numpy().reshape(n, tables, probes)
    bucket = c.reshape(n, -1)[np.arange(n), np.abs(spot)]
    counts = np.zeros(n, np.int64)
    forest, edges = Forest(n), []

    def near(a, b):
        return np.einsum("ij,ij->i", x[a], x[b]) >= THRESHOLD

    for a, b in _pairs(np.asarray(starts), n, spot >= 0, near, lambda a, b: x[a] @ x[b].T >= THRESHOLD, dim):
        keep = (cid[a] != cid[b]) & ~(split[a] & (home[a] == home[b]))
        a, b = a[keep], b[keep]
        lo, hi = np.where(cid[a] < cid[b], a, b), np.where(cid[a] < cid[b], b, a)
        for k in range(0, len(lo), 65_536):
            p, q = lo[k : k + 65_536], hi[k : k + 65_536]
            at_p = (c[p, :, :1] == c[q]).any(axis=2)  # q is sent to p's own bucket, by table
            at_q = (c[q, :, :1] == c[p]).any(axis=2)
            first = (at_p | at_q).argmax(axis=1)
            each = np.arange(len(p))
            where = np.where(at_p[each, first], c[p, first, 0], c[q, first, 0])
            here = (first == place[p]) & (where == bucket[p])
            p, q = p[here], q[here]
            np.add.at(counts, p, twins[q])
            np.add.at(counts, q, twins[p])
            for m, o in zip(p.tolist(), q.tolist(), strict=True):
                if forest.join(m, o):
                    edges.append((m, o))
    return counts, edges, cid


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@scoped("vec-groups")
def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    spark = vectors.sparkSession
    rows = materialize(_rows(vectors), "vec-rows")
    classes = (
        rows.where("vec is not null")
        .groupBy("label", "dim", "key")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = materialize(classes, "vec-classes")
    sizes = materialize(classes.groupBy(F.col("label").alias("_label"), F.col("dim").alias("_dim")).agg(F.count("*").alias("n")), "vec-sizes")

    def hashed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw, dims, n = (part.column(k).to_pylist() for k in ("vec", "dim", "n"))
                shape = [shape_for(m, d) for m, d in zip(n, dims, strict=True)]
                kinds: dict[tuple, list[int]] = {}
                for r, (d, how) in enumerate(zip(dims, shape, strict=True)):
                    kinds.setdefault((d, how), []).append(r)
                made: list = [None] * len(raw)
                marks = np.zeros((len(raw), 2), np.int64)
                for (d, how), which in kinds.items():
                    x = unit([raw[r] for r in which], d)
                    marks[which] = signs(x)
                    for r, row in zip(which, codes(x, *how).reshape(len(which), -1), strict=True):
                        made[r] = row
                new = [
                    pa.array(made, pa.list_(pa.int64())),
                    pa.array(marks[:, 0].copy()),
                    pa.array(marks[:, 1].copy()),
                    pa.array([t for _, t, _ in shape], pa.int32()),
                    pa.array([p for _, _, p in shape], pa.int32()),
                ]
                old = ("label", "dim", "key", "cid", "least", "copies", "vec")
                names = [*old, "codes", "s0", "s1", "tables", "probes"]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in old], *new], names=names)

    ship(spark)
    same = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    schema = (
        "label bigint, dim int, key binary, cid bigint, least bigint, copies bigint, vec binary,"
        " codes array<bigint>, s0 bigint, s1 bigint, tables int, probes int"
    )
    coded = classes.join(_bounded(sizes), same).select(*classes.columns, "n").mapInArrow(hashed, schema)
    classes = materialize(coded, "vec-codes")
    # a row for each table and probe: spot is the code's place in codes, negative in buckets other than the vector's own
    sent = classes.select("label", "dim", "cid", "s0", "s1", "probes", F.posexplode("codes").alias("at", "bucket")).where("bucket >= 0")
    sent = sent.select(
        F.xxhash64("label", "dim", F.floor(F.col("at") / F.col("probes")), "bucket").alias("place"),
        "cid",
        "s0",
        "s1",
        F.when(F.col("at") % F.col("probes") == 0, F.col("at")).otherwise(-F.col("at")).alias("spot"),
    )
    loads = sent.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = materialize(loads.select(F.col("place").alias("_place"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "vec-large")
    sent = sent.join(_bounded(large), F.col("place") == F.col("_place"), "left")

    def likely(batches):
        for part, starts in whole_groups(batches, ["place"]):
            rows = _likely(part, starts)
            yield from part.select(["cid", "spot"]).take(pa.array(rows)).to_batches()

    small = sent.where("blocks is null").select("place", "cid", "s0", "s1", "spot").repartition("place").sortWithinPartitions("place")
    kept = small.mapInArrow(likely, "cid bigint, spot int").withColumn("blocks", F.lit(1).cast("long"))
    kept = kept.unionByName(sent.where("blocks is not null").select("cid", "spot", "blocks"))
    kept = materialize(kept.withColumnRenamed("cid", "_cid"), "vec-kept")
    cut = classes.join(kept, F.col("cid") == F.col("_cid"))
    cut = cut.withColumn("home", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("i", F.least("home", "other")).withColumn("j", F.greatest("home", "other"))
    cut = cut.withColumn("bucket", F.element_at("codes", F.abs("spot") + 1)).withColumn("tab", F.floor(F.abs("spot") / F.col("probes")))
    keys = ["dim", "probes", "label", "tab", "bucket", "i", "j"]

    def compared(batches):
        for table, starts in whole_groups(batches, keys):
            # runs of groups of one shape
            ends, kinds = [*starts[1:], table.num_rows], [table.column(k).to_numpy() for k in ("dim", "probes")]
            at = 0
            while at < len(starts):
                to = at
                rows = 0
                while to < len(starts) and all(k[starts[to]] == k[starts[at]] for k in kinds) and (to == at or rows < BLOCK):
                    rows += ends[to] - starts[to]
                    to += 1
                part = table.slice(starts[at], ends[to - 1] - starts[at])
                counts, edges, cid = _meetings(part, [g - starts[at] for g in starts[at:to]])
                at = to
                some = np.flatnonzero(counts)
                a = np.concatenate([cid[some], cid[[m for m, _ in edges]] if edges else np.empty(0, np.int64)])
                b = np.concatenate([np.full(len(some), -1), cid[[n for _, n in edges]] if edges else np.empty(0, np.int64)])
                n = np.concatenate([counts[some], np.zeros(len(edges), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (a, b, n)], names=["a", "b", "n"])

    columns = [*keys, "tables", "cid", "copies", "spot", "home", "vec", "codes"]
    found = cut.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "a bigint, b bigint, n bigint")
    found = materialize(found, "vec-found")
    counts = found.where("b = -1").groupBy("a").agg(F.sum("n").alias("n"))
    comps = components(found.where("b >= 0").select("a", "b"))
    known = (
        classes.select("label", "dim", "key", "cid", "least", "copies")
        .join(counts, F.col("cid") == F.col("a"), "left")
        .join(comps, F.col("cid") == F.col("id"), "left")
        .withColumn("comp", F.coalesce("component", "cid"))
    )
    least = known.groupBy("comp").agg(F.min("least").alias("component_id")).withColumnRenamed("comp", "_comp")
    known = known.join(least, F.col("comp") == F.col("_comp")).select(
        F.col("label").alias("_label"),
        F.col("dim").alias("_dim"),
        F.col("key").alias("_key"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    linked = rows.where("vec is not null").join(
        known, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("key") == F.col("_key"))
    )
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
