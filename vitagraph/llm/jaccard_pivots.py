"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

Texts are sets of word shingles, and 1 - Jaccard is a metric in which linked texts are at
most 0.15 apart.  Nearly all texts are at distance 1 from each other, where no pivot tells
them apart, so the space is cut by three kinds of pivots, one after another:

1. Sets of a single shingle.  Only the nearest of these matter to x, its own shingles, taken in
   one global order (rare before frequent).  x may lose |x| - ceil(0.85 |x|) of them on the way
   to a linked y; replicated into the regions of one more, x meets every y it may link with.
2. The empty set, whose distance is the size: rings of sizes up to a power of two.  A text of an
   outer ring that may link into an inner one stands in its window too.
3. Documents.  A region of more than ``BLOCK`` rows is dealt to the Voronoi cells of some of its
   documents, again and again until cells are small; within a task regions of more than ``LEAF``
   rows go on likewise.  A row belongs to the cell of its nearest pivot q, and to the window of
   any earlier cell p with d(y, p) <= d(y, q) + 2 r, where r bounds how far a linked text may be.
   By the triangle inequality a linked pair of two cells so meets in the earlier one, and only
   there: a row notes at which levels it is in a window, and two rows that share such a level
   are not compared.

The distance d to documents is the number of differing parities of a set's overlaps with fixed
parts of the universe.  It is a metric too, and no larger than the symmetric difference, so
linked texts, whose symmetric difference is at most 0.15 |x or y|, stay within r.  A cut that
does not lessen the work is not made: such a region is cut into blocks that join pairwise.

Pairs leave a task only if their parities allow a link, and are then compared exactly, on the
whole shingle sets of both texts.

There are two rounds.  First, a forest of likely links is verified in the nearest shared
regions of each document; what links there is closed transitively.  Then all regions that
still hold more than one component are joined fully, but only across components: what is
connected already needs no further comparison.  So large groups of near copies cost a
comparison or so for each member, and no link between components is lost.

Equal shingle sets are one class from the start.  Frequent shingles (in over ``HOT``
documents, the most frequent ``MAX_HOT`` of these) are ordered last.  Any such list gives a
correct order, so its bound affects cost only.

Edge cases: null, empty and wordless texts have the empty set, which links with nothing;
a text of fewer words than a shingle has its whole sequence as one; repeated rows and
copies share their class; a null doc_id takes part and is the least id of a component only
if all are null; only doc_id and text are read; an empty table gives an empty result.
Shingles are told apart by 64-bit hashes, shingle sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Forest, arrow_map, discard, materialize, scoped, segments, ship, tidied, whole_groups
from .components import components
from .shingles import WordHashes, shingle_set

#: Fewest parts of the universe whose parities are kept, and parts for each shingle (a power of two is taken).
PARTS = 64
PARITIES = 4
#: Most parities that a row takes into a region; all of them are looked at once a pair has left it.
CARRY = 4096
HOT = 64
MAX_HOT = 100_000
#: Shingles kept beyond the window, from which those that replace frequent ones are taken.
SLACK = 16
#: Rows of a region that one task joins; pivots that cut a larger one, and how often this is tried.
BLOCK = 1024
PIVOTS = 16
LEVELS = 4
#: Rows that are compared directly within a task.
LEAF = 96
#: Number of the first ring; cells have the numbers that follow from their region's.
RING = 64
#: Bits of ``outer``: 0 for rings, 1 to LEVELS for cells of tables, from this one on for cells within a task.
INNER = 8
#: A cut by pivots is made if it leaves at most this share of the comparisons.
GAIN = 0.8
#: Texts that are compared together.
VERIFY = 256
#: Nearest shared regions in which a document is connected first.
NEAREST = 3
#: Up to this number, keys of texts and pivots of regions are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 400_000
BROADCAST_REGIONS = 2_000


class Limit:
    """Two sets link when ``100 * common >= percent * union``."""

    def __init__(self, percent: int):
        self.percent = percent

    def window(self, n: int) -> int:
        """Nearest pivots that a set of size n is replicated to."""
        return n - -(-self.percent * n // 100) + 1

    def sizes(self, a, b):
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def common(self, shared, a, b):
        return (100 + self.percent) * shared >= self.percent * (a + b)

    def apart(self, distance, a, b):
        """Whether the symmetric difference may be as large as ``distance``."""
        return (100 + self.percent) * (a + b - distance) >= 2 * self.percent * (a + b)

    def reach(self, n):
        """Largest symmetric difference between a set of size n and any that it may link with."""
        return (100 - self.percent) * n // self.percent

    def rings(self, n: int) -> list[int]:
        """The ring of a set of size n, and the inner ones whose window it is in."""
        own = (n - 1).bit_length()
        out = [own]
        while out[-1] and self.percent * n <= 100 << (out[-1] - 1):
            out.append(out[-1] - 1)
        return out


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities by fewer parts: residues of the hashes, so halves fold onto each other."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _distance(x: np.ndarray, y: np.ndarray) -> int:
    """Least symmetric difference of two sets: each element of it flips one parity."""
    k = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, k) ^ _folded(y, k)).sum())


def _width(ring: int) -> int:
    """Bytes of the parities that rows of a ring carry."""
    return min(max(PARTS, 1 << ring), CARRY) // 8


def _fold_all(raw: list[bytes], size: int) -> np.ndarray:
    """Parities of many sets, folded to ``size`` bytes, as rows of 64-bit words."""
    out = np.empty((len(raw), size), np.uint8)
    lengths = np.array([len(b) for b in raw])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        bits = np.frombuffer(b"".join([raw[k] for k in at]), np.uint8).reshape(len(at), -1, size)
        out[at] = bits[:, 0] if length == size else np.bitwise_xor.reduce(bits, axis=1)
    return out.view(np.uint64)


def _sketch(docs: DataFrame, words: int, limit: Limit) -> DataFrame:
    """doc_id, txt (digest of the text), n, key (digest of the set), bits (parities of its overlaps with parts
    of the universe), code (these folded to what regions carry), low (its least hashes)."""

    def make():
        known = WordHashes()

        def step(columns: list[list]) -> list[list]:
            out: list[list] = [columns[0], columns[1], [], [], [], [], []]
            for text in columns[2]:
                s = shingle_set(text, words, known)
                n = len(s)
                out[2].append(n)
                if n:
                    out[3].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    k = PARTS << max(0, (PARITIES * n - 1) // PARTS).bit_length()
                    odd = np.bincount((s & np.uint64(k - 1)).astype(np.int64), minlength=k) & 1
                    bits = np.packbits(odd.astype(bool), bitorder="little")
                    out[4].append(bits.tobytes())
                    out[5].append(_folded(bits, _width((n - 1).bit_length())).tobytes())
                    out[6].append(s[: limit.window(n) + SLACK].tobytes())
                else:
                    for k in (3, 4, 5, 6):
                        out[k].append(None)
            return out

        return step

    text = F.col("text").cast("string")
    return arrow_map(
        docs,
        [F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("txt"), text.alias("text")],
        "doc_id bigint, txt binary, n bigint, key binary, bits binary, code binary, low binary",
        make,
    )


def _explode(classes: DataFrame, limit: Limit, hot: np.ndarray | None, often: np.ndarray | None, ask: str) -> DataFrame:
    """From each class: ``near`` its window's shingles in hash order; ``spare`` the frequent shingles
    that must lose their late place; ``place`` (s, g, outer, cid, size and place in one number) of its
    window, for its ring and those whose window it is in (``outer`` = 1)."""

    def order(low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(hot, low)
        at[at == len(hot)] = 0
        is_hot = hot[at] == low if len(hot) else np.zeros(len(low), bool)
        return is_hot, at

    def step(batches):
        for batch in (part.slice(at, 1000) for part in batches for at in range(0, part.num_rows, 1000)):
            sizes, lows = batch.column("n").to_pylist(), batch.column("low").to_pylist()
            made, cids, spots, rings, outer = [], [], [], [], []
            cid_of = batch.column("cid").to_pylist()
            for row, (n, data) in enumerate(zip(sizes, lows, strict=True)):
                low = np.frombuffer(data, np.uint64)
                m = limit.window(n)
                if ask == "near":
                    made.append(low[:m])
                    continue
                is_hot, at = order(low, n)
                if ask == "spare":
                    lack = m - int((~is_hot).sum())
                    if lack > 0 and len(low) < n:
                        # not enough others are known: the least frequent of the frequent take their hash place
                        ranks = at[is_hot]
                        made.append(low[is_hot][np.argsort(often[ranks], kind="stable")[:lack]])
                    continue
                chosen = np.concatenate([low[~is_hot], low[is_hot]])[:m]
                for nth, ring in enumerate(limit.rings(n)):
                    made.append(chosen)
                    cids.append(np.full(len(chosen), cid_of[row]))
                    spots.append((n << 32) + np.arange(len(chosen)))
                    rings.append(np.full(len(chosen), RING + ring))
                    outer.append(np.full(len(chosen), min(nth, 1)))
            s = np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)
            columns = [pa.array(s)]
            names = ["s"]
            if ask == "place":
                empty = np.empty(0, np.int64)
                columns += [pa.array(np.concatenate(v).astype(np.int64) if v else empty) for v in (cids, spots, rings, outer)]
                names += ["cid", "spot", "g", "outer"]
            for at in range(0, len(s), 50_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names=names)

    schema = "s bigint" + ", cid bigint, spot bigint, g bigint, outer bigint" * (ask == "place")
    return classes.select("cid", "n", "low").mapInArrow(tidied(step), schema)


def _frequent(classes: DataFrame, limit: Limit) -> np.ndarray:
    """Sorted hashes of the frequent shingles that go last in the order; at most MAX_HOT."""
    counts = _explode(classes, limit, None, None, "near").groupBy("s").count().where(F.col("count") > HOT)
    rows = counts.orderBy(F.desc("count"), "s").limit(MAX_HOT).collect()
    hot = np.array([r["s"] for r in rows], np.int64).view(np.uint64)
    often = np.array([r["count"] for r in rows], np.int64)
    rank = np.argsort(hot)
    hot, often = hot[rank], often[rank]
    if len(hot):
        spare = [r["s"] for r in _explode(classes, limit, hot, often, "spare").distinct().collect()]
        hot = np.setdiff1d(hot, np.array(spare, np.int64).view(np.uint64))
    return hot


def _forests(rows: DataFrame, limit: Limit) -> DataFrame:
    """Pairs (a, b) that would connect the rows of a region: rows hold s, g, sub, cid, spot, bits.

    Each row proposes the nearest member, by parities, of each component before it that it may
    link with.  The bound is close, so nearly all of these links hold, and a row of pairs for
    each member is enough to find nearly all connections of a region.
    """
    keys = ["s", "g", "sub"]

    def step(batches):
        for table, starts in whole_groups(batches, keys):
            cid, spot = (table.column(k).to_numpy() for k in ("cid", "spot"))
            size = spot >> 32
            raw = table.column("bits").to_pylist()
            a, b = [], []
            for start, end in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if end - start < 2:
                    continue
                # by size, so widths of the parities ascend; all are folded to the least
                bits, n = _fold_all(raw[start:end], len(raw[start])), size[start:end]
                forest = Forest(end - start)
                for k in range(1, end - start):
                    since = int(np.searchsorted(100 * n[:k], limit.percent * n[k]))
                    far = np.bitwise_count(bits[since:k] ^ bits[k]).sum(axis=1)
                    near = np.flatnonzero(limit.apart(far, n[since:k], n[k]))
                    for o in near[np.argsort(far[near], kind="stable")].tolist():
                        if forest.join(since + o, k):
                            x, y = int(cid[start + since + o]), int(cid[start + k])
                            a.append(min(x, y))
                            b.append(max(x, y))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b)], names=["a", "b"])

    columns = [*keys, "cid", "spot", "bits"]
    dealt = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "spot", "cid")
    return dealt.mapInArrow(tidied(step), "a bigint, b bigint")


def _nearest_cells(far: np.ndarray, reach) -> tuple[np.ndarray, np.ndarray]:
    """From distances (rows, pivots): the own cell of each row, and (rows, pivots) of the earlier cells whose window it is in."""
    own = far.argmin(axis=1)
    least = far[np.arange(len(far)), own]
    window = (far <= (least + 2 * reach)[:, None]) & (np.arange(far.shape[1]) < own[:, None])
    return own, window


def _cells(rows: DataFrame, pivots: DataFrame, level: int, limit: Limit) -> DataFrame:
    """The rows of large regions in the cells of their pivots and the windows around these."""
    inputs = [*ROW, "w", "marks"]

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("spot").to_numpy() >> 32
            take, cell, outer = [], [], []
            codes, marks = batch.column("code").to_pylist(), batch.column("marks").to_pylist()
            for k, w in enumerate(batch.column("w").to_pylist()):
                far = np.bitwise_count(_fold_all(marks[k], w) ^ _fold_all([codes[k]], w)).sum(axis=1)
                own, window = _nearest_cells(far[None, :].astype(np.int64), np.array([limit.reach(size[k])]))
                near = np.flatnonzero(window[0])
                take += [k] * (1 + len(near))
                cell += [int(own[0]), *near.tolist()]
                outer += [0] + [1 << level] * len(near)
            part = batch.select(ROW).take(pa.array(take))
            g = part.column("g").to_numpy() * PIVOTS + np.array(cell)
            mask = part.column("outer").to_numpy() | np.array(outer)
            columns = {name: part.column(name) for name in ROW} | {"g": pa.array(g, pa.int64()), "outer": pa.array(mask, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[name] for name in ROW], names=ROW)

    joined = rows.join(pivots, (F.col("s") == F.col("_s")) & (F.col("g") == F.col("_g"))).select(*inputs)
    return joined.mapInArrow(tidied(step), ROW_SCHEMA)


def _regions(rows: DataFrame, limit: Limit) -> DataFrame:
    """Rows by region (s, g), large ones cut by pivots, and by blocks (i, j) where pivots don't help."""
    done, blunt = [], []
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("s", "g").agg(F.count("*").alias("n"), F.min(F.length("code")).alias("w"))
        big = materialize(sizes.where(F.col("n") > BLOCK).select(F.col("s").alias("_s"), F.col("g").alias("_g"), "n", "w"), "jaccard-regions")
        regions = big.count()
        if not regions:
            break
        hint = F.broadcast if regions <= BROADCAST_REGIONS else (lambda df: df)
        here = (F.col("s") == F.col("_s")) & (F.col("g") == F.col("_g"))
        done.append(rows.join(hint(big), here, "left_anti"))
        large = rows.join(hint(big.drop("n")), here).drop("_s", "_g")
        slot = F.pmod(F.xxhash64("cid"), F.lit(PIVOTS))
        marks = large.groupBy("s", "g", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("cid", F.lit(level)), "code")).alias("m"), F.min("w").alias("w"))
        marks = marks.groupBy(F.col("s").alias("_s"), F.col("g").alias("_g")).agg(F.min("w").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("slot", "m"))), lambda x: x["m"]["code"]).alias("marks"))
        marks = materialize(marks, "jaccard-pivots")
        cut = _cells(large.drop("w"), hint(marks), level, limit)
        # how many comparisons the cut leaves
        left = cut.groupBy("s", "g").count().groupBy("s", F.floor(F.col("g") / PIVOTS).alias("g")).agg(F.sum(F.col("count") * F.col("count")).alias("left"))
        gain = left.join(big, here).where(F.col("left") <= GAIN * F.col("n") * F.col("n")).select("_s", "_g")
        gain = materialize(gain, "jaccard-gains")
        blunt.append(large.drop("w").join(hint(gain), here, "left_anti"))
        rows = materialize(_cells(large.drop("w"), hint(marks.join(gain, ["_s", "_g"], "left_semi")), level, limit), "jaccard-cells")
    whole = rows
    for part in done:
        whole = whole.unionByName(part)
    for part in blunt:
        whole = whole.unionByName(part)
    if not done:
        return whole.select("*", *[F.lit(0).cast("long").alias(c) for c in ("home", "i", "j")])
    sizes = whole.groupBy("s", "g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    sizes = materialize(sizes.select(F.col("s").alias("_s"), F.col("g").alias("_g"), "blocks"), "jaccard-blocks")
    if sizes.count() <= BROADCAST_REGIONS:
        sizes = F.broadcast(sizes)
    whole = whole.join(sizes, (F.col("s") == F.col("_s")) & (F.col("g") == F.col("_g")), "left")
    whole = whole.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("home", F.pmod(F.xxhash64("cid"), "blocks"))
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return whole.select(*ROW, "home", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"))


def _leaves(code: np.ndarray, size: np.ndarray, outer: np.ndarray, limit: Limit):
    """Index pairs to compare among the rows of one region: cut by Voronoi cells of pivots until small."""
    todo = [(np.arange(len(code)), outer, INNER)]
    while todo:
        rows, outer, level = todo.pop()
        if len(rows) > LEAF and level < 62:
            step = len(rows) // PIVOTS
            far = np.stack([np.bitwise_count(code[rows] ^ code[p]).sum(axis=1) for p in rows[::step][:PIVOTS]], axis=1).astype(np.int64)
            reach = limit.reach(size[rows])
            own, window = _nearest_cells(far, reach)
            parts = []
            for p in range(far.shape[1]):
                core, win = np.flatnonzero(own == p), np.flatnonzero(window[:, p])
                if not len(core):
                    continue
                low, high = far[core, p].min(), far[core, p].max()
                win = win[(far[win, p] - reach[win] <= high) & (far[win, p] + reach[win] >= low)]
                parts.append((core, win))
            if sum((len(core) + len(win)) ** 2 for core, win in parts) <= GAIN * len(rows) ** 2:
                for core, win in parts:
                    both = np.concatenate([core, win])
                    mask = outer[both]
                    mask[len(core) :] |= 1 << level
                    todo.append((rows[both], mask, level + 1))
                continue
        for at in range(0, len(rows), 256):
            k, o = np.nonzero((outer[at : at + 256, None] & outer[None, at:]) == 0)
            k, o = k[o > k] + at, o[o > k] + at
            if len(k):
                yield rows[k], rows[o]


def _across(rows: DataFrame, limit: Limit) -> DataFrame:
    """All pairs (a, b) of different components in a region whose parities allow a link."""
    keys = ["s", "g", "i", "j"]

    def pairs(starts, ends, codes, size, outer):
        """Rows k and o of one region: shifted against each other for all small regions at once, the large ones by pivots."""
        group = np.zeros(len(size), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        small = (ends - starts <= LEAF)[group]
        for d in range(1, int((ends - starts)[ends - starts <= LEAF].max(initial=1))):
            k = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            if len(k):
                yield k, k + d
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start > LEAF:
                width, at = codes.width[start], codes.at[start:end]
                for k, o in _leaves(codes.rows[width][at], size[start:end], outer[start:end], limit):
                    yield k + start, o + start

    def step(batches):
        for table, first in whole_groups(batches, keys):
            starts = np.array(first)
            ends = np.array([*first[1:], table.num_rows])
            cid, spot, outer, comp, home, i, j = (table.column(c).to_numpy() for c in ("cid", "spot", "outer", "comp", "home", "i", "j"))
            size, place = spot >> 32, spot & 0xFFFFFFFF
            cut = i != j
            codes = _Codes(table.column("code").to_pylist(), starts, ends)
            for k, o in pairs(starts, ends, codes, size, outer):
                fit = (comp[o] != comp[k]) & ((outer[o] & outer[k]) == 0) & limit.sizes(size[o], size[k])
                fit &= ~(cut[k] & (home[o] == home[k]))
                # s is the first shingle in common, so what comes before it is not
                fit &= limit.common(np.minimum(size[o] - place[o], size[k] - place[k]), size[o], size[k])
                k, o = k[fit], o[fit]
                if len(k):
                    fit = limit.apart(codes.far(k, o), size[o], size[k])
                    k, o = k[fit], o[fit]
                if len(k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(cid[k], cid[o])), pa.array(np.maximum(cid[k], cid[o]))], names=["a", "b"]
                    )

    columns = [*keys, "cid", "spot", "outer", "comp", "home", "code"]
    dealt = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidied(step), "a bigint, b bigint")


class _Codes:
    """Parities of the rows of several regions, those of a region folded to the least width in it."""

    def __init__(self, raw: list[bytes], starts: np.ndarray, ends: np.ndarray):
        lengths = np.array([len(b) for b in raw])
        self.width = np.repeat(np.minimum.reduceat(lengths, starts), ends - starts)
        self.at = np.zeros(len(raw), np.int64)
        self.rows = {}
        for w in np.unique(self.width).tolist():
            here = np.flatnonzero(self.width == w)
            self.at[here] = np.arange(len(here))
            self.rows[w] = _fold_all([raw[k] for k in here], w)

    def far(self, k: np.ndarray, o: np.ndarray) -> np.ndarray:
        out = np.empty(len(k), np.int64)
        for w, rows in self.rows.items():
            here = np.flatnonzero(self.width[k] == w)
            for part in np.array_split(here, len(here) * w // 16_000_000 + 1):
                out[part] = np.bitwise_count(rows[self.at[k[part]]] ^ rows[self.at[o[part]]]).sum(axis=1)
        return out


#: A row of a region: its shingle and the number of its ring or cell, the levels whose window it is in, the document.
ROW = ["s", "g", "outer", "cid", "spot", "comp", "code"]
ROW_SCHEMA = "s bigint, g bigint, outer bigint, cid bigint, spot bigint, comp bigint, code binary"


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, limit: Limit) -> DataFrame:
    """The pairs that link, by the whole shingle sets of both texts.

    Each text travels once, to the group of all pairs that it is connected with; groups of
    more than ``VERIFY`` texts are cut into blocks that meet pairwise.
    """

    def near(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                na, nb = (batch.column(k).to_numpy() for k in ("na", "nb"))
                keep = limit.sizes(na, nb)
                ba, bb = batch.column("ba"), batch.column("bb")
                for k in np.flatnonzero(keep).tolist():
                    far = _distance(np.frombuffer(ba[k].as_py(), np.uint8), np.frombuffer(bb[k].as_py(), np.uint8))
                    keep[k] = limit.apart(far, na[k], nb[k])
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    met = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    met = met.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(tidied(near), "a bigint, b bigint")
    met = materialize(met, "jaccard-pairs")
    groups = components(met)
    sizes = groups.groupBy(F.col("component").alias("_c")).agg(F.ceil(F.count("*") / VERIFY).alias("blocks"))
    groups = groups.join(sizes, F.col("component") == F.col("_c")).drop("_c")
    groups = groups.withColumn("home", F.pmod(F.xxhash64("id"), "blocks"))
    members = materialize(groups.join(classes.select("cid", "txt"), F.col("id") == F.col("cid")).drop("cid"), "jaccard-members")
    keys = members.select(F.col("txt").alias("k")).distinct()
    if members.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    text = F.col("text").cast("string")
    texts = docs.select(F.unhex(F.md5(text)).alias("t"), text.alias("body")).join(keys, F.col("t") == F.col("k"), "left_semi")
    texts = texts.groupBy("t").agg(F.first("body").alias("body"))
    spots = ["component", "i", "j"]
    ends = [members.select(F.col("id").alias(x), "component", F.col("home").alias(f"h{x}")) for x in ("a", "b")]
    asked = met.join(ends[0], "a").join(ends[1].drop("component"), "b")
    asked = asked.select("component", F.least("ha", "hb").alias("i"), F.greatest("ha", "hb").alias("j"), "a", "b")
    asked = materialize(asked, "jaccard-asked")
    # a text goes only where one of its pairs is
    places = asked.select("i", "j", F.explode(F.array("a", "b")).alias("m")).distinct()
    whole = members.join(texts, F.col("txt") == F.col("t")).join(places, F.col("id") == F.col("m"))
    whole = whole.select(*spots, F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), "body")
    asked = asked.withColumn("body", F.lit(None).cast("string"))

    def compare(batches):
        known = WordHashes()
        for part in segments(batches, spots):
            a, b = (part.column(k).to_numpy() for k in ("a", "b"))
            owners = int((b < 0).sum())  # texts come first
            if owners == len(a):
                continue
            sets = {
                int(a[k]): shingle_set(body, words, known) for k, body in enumerate(t.as_py() for t in part.column("body").slice(0, owners))
            }
            found = []
            for x, y in zip(a[owners:].tolist(), b[owners:].tolist(), strict=True):
                p, q = sets[x], sets[y]
                both = np.concatenate([p, q])
                both.sort(kind="stable")  # two sorted runs: a merge
                shared = int((both[1:] == both[:-1]).sum())
                if limit.common(shared, len(p), len(q)):
                    found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])

    dealt = whole.unionByName(asked).repartition(*spots).sortWithinPartitions(*spots, "b")
    return dealt.mapInArrow(tidied(compare), "a bigint, b bigint")


@scoped("jaccard-groups")
def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, txt, n_shingles, component_id, keeper: one row for each document.

    ``txt`` is the MD5 of the text; ``keeper`` (doc_id, txt) names the document of its
    component that stays where one of each is kept.
    """
    ship(docs.sparkSession)
    limit = Limit(percent)
    rows = materialize(_sketch(docs, words, limit), "jaccard-rows")
    classes = (
        rows.where("n > 0")
        .groupBy("key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "txt")).alias("least"),
            *[F.first(c).alias(c) for c in ("n", "bits", "code", "low", "txt")],
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = materialize(classes, "jaccard-classes")
    whole, rows = rows, materialize(rows.select("doc_id", "txt", "n", "key"), "jaccard-rows")
    discard(whole)
    hot = _frequent(classes, limit)
    placed = _explode(classes, limit, hot, None, "place")
    placed = placed.withColumn("df", F.count("*").over(Window.partitionBy("s", "g"))).where("df > 1")
    placed = materialize(placed, "jaccard-places")
    whole, classes = classes, materialize(classes.drop("low"), "jaccard-classes")
    discard(whole)

    # a forest of likely links in the nearest shared regions of each document; in a large region the rows
    # are dealt to parts, and a few of them are in all parts, so that these are connected too
    nth = F.dense_rank().over(Window.partitionBy("cid").orderBy(F.col("spot").bitwiseAND(0xFFFFFFFF)))
    nearest = placed.withColumn("nth", nth).where(F.col("nth") <= NEAREST)
    subs = F.ceil(F.col("df") / BLOCK)
    common = (subs > 1) & (F.pmod(F.xxhash64("cid", F.lit(7)), F.col("df")) < PIVOTS)
    part = F.array(F.pmod(F.xxhash64("cid"), subs))
    nearest = nearest.withColumn("sub", F.explode(F.when(common, F.sequence(F.lit(0).cast("long"), subs - 1)).otherwise(part)))
    nearest = nearest.select("s", "g", "sub", "cid", "spot").join(classes.select("cid", "bits"), "cid")
    links = materialize(_verify(_forests(nearest, limit), classes, docs, words, limit), "jaccard-links")
    comp = components(links)

    known = placed.drop("df").join(comp, F.col("cid") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "cid"))
    known = materialize(known.select("s", "g", "outer", "cid", "spot", "comp"), "jaccard-known")
    open_ = known.groupBy(F.col("s").alias("_s"), F.col("g").alias("_g")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("outer").alias("core"))
    open_ = known.join(open_.where("lo < hi and core = 0"), (F.col("s") == F.col("_s")) & (F.col("g") == F.col("_g")), "left_semi")
    open_ = materialize(open_.join(classes.select("cid", "code"), "cid").select(*ROW), "jaccard-open")
    found = materialize(_verify(_across(_regions(open_, limit), limit), classes, docs, words, limit), "jaccard-links")
    comp = components(links.unionByName(found))

    known = classes.select(F.col("key").alias("_key"), "cid", "least").join(comp, F.col("cid") == F.col("id"), "left")
    known = known.withColumn("comp", F.coalesce("component", "cid"))
    first = known.groupBy("comp").agg(F.min("least").alias("first")).withColumnRenamed("comp", "_comp")
    known = known.join(first, F.col("comp") == F.col("_comp")).select("_key", "first")
    linked = rows.where("n > 0").join(known, F.col("key") == F.col("_key")).select(
        "doc_id",
        "txt",
        F.col("n").alias("n_shingles"),
        F.col("first.doc_id").alias("component_id"),
        F.struct("first.doc_id", "first.txt").alias("keeper"),
    )
    alone = rows.where("n = 0").select(
        "doc_id",
        "txt",
        F.col("n").alias("n_shingles"),
        F.col("doc_id").alias("component_id"),
        F.struct("doc_id", "txt").alias("keeper"),
    )
    return linked.unionByName(alone)
