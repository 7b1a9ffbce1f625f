"""A trie of conversation prefixes over the whole corpus, merged family by family first.

Conversations come in families: those whose ids share a base start with the first turns of
the base conversation.  A conversation is rebuilt from its head (the base's turns) and its
own later turns.  Each distinct sequence of first turns is a node of the trie.

* Turns go to their family as a digest of role and text and a number of words; texts stay
  where they are.
* The base's turns and the other members' turns are cogrouped by base; a family's small trie
  is built there, and only its nodes, each once however many members pass it, go on.
* Family nodes are merged by what identifies a prefix: the sum of the digests of its turns,
  each with its depth, to 128 bits.  As a sum, it can be worked out in parts.

A node is called after its smallest member, its owner.  What a member owns is the rest of its
path from some depth on, so one number for each conversation, from a first merge, tells its
family all about it.  Each conversation then adds to every node on its path: one member; a
leaf if it owns one; a child where it owns the next node; and as saved tokens the words
below that it does *not* own, since a node of n members is paid for once instead of n
times.  A family adds these up in its trie, and a second merge adds up the families.

Hot keys: a prefix that a third of all conversations share is a row for each family, partly
aggregated before it moves.  The ids that end at a node are joined to strings for blocks of
families, and one task hashes these strings in order as they come, holding one batch.  A
conversation of more than ``PIECE`` turns takes part in its family with the first ``PIECE`` of
them; the others are a chain of nodes, numbered and summed in tables, a piece at a time.

Edge cases: rows without ``conv_id`` belong to no conversation and are left out; turns without
a number come first, and turns of one number go by the digest of role and text; null role and
text are empty; repeated rows are repeated turns; a remainder has the sign of its number, as
in SQL, so the family of base 0 reaches from -19 to 19; only the four columns are read, so
further ones never clash; an empty table has no node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import in_order
from .common import materialize, n_words, scoped, ship, tidied

#: Conversations whose ids differ by less, from a multiple of it on, are a family; heads are shorter than HEADS turns.
FAMILY, HEADS = 20, 4
#: Turns of a conversation that its family works on in one task; more than a head has.
PIECE = 4_096
#: Families whose ending ids are joined to one string.
BLOCK = 64
MASK = (1 << 128) - 1


def head_turns(conv_id: int) -> int:
    """How many of the base's turns a conversation starts with."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def salted(key: bytes, depth: int) -> int:
    """What a turn adds to the identity of the prefixes it is in."""
    return int.from_bytes(hashlib.sha256(b"%s:%d" % (key.hex().encode(), depth)).digest()[:16])


def turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, turn, key (digest of role and text), words; no texts."""
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256), 1, 32))
    return conversations.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), n_words(text).alias("words")
    )


NODES = (
    "base bigint, place int, up int, node binary, conv_id bigint, depth int, n bigint, words bigint, goes_on boolean, ends string,"
    " beyond array<bigint>"
)


class Node:
    __slots__ = ("beyond", "children", "depth", "ends", "least", "n", "node", "up", "words")

    def __init__(self, up: int, depth: int, node: int, words: int):
        self.up, self.depth, self.node, self.words = up, depth, node, words
        self.n, self.least, self.children = 0, None, {}
        self.ends: list[int] = []
        self.beyond: list[int] = []  # members whose further turns are not in the family's trie


def family_trie(base: int, rows: list[tuple]) -> list[Node]:
    """The trie of a family, parents first, from rows (conv_id, has a turn, turn, key, words, more)."""
    rows.sort()
    own: dict[int, list[tuple[bytes, int]]] = {}
    more = set()
    for conv, _, _, key, words, goes_on in rows:
        own.setdefault(conv, []).append((key, words))
        if goes_on:
            more.add(conv)
    nodes = [Node(-1, 0, 0, 0)]
    for conv in sorted(own):
        h, at = head_turns(conv), 0
        path = own.get(base, [])[:h] + own[conv][h:]
        for depth in range(len(path) + 1):
            if depth:
                key, words = path[depth - 1]
                found = nodes[at].children.get(key)
                if found is None:
                    found = nodes[at].children[key] = len(nodes)
                    nodes.append(Node(at, depth, (nodes[at].node + salted(key, depth)) & MASK, words))
                at = found
            nodes[at].n += 1
            if nodes[at].least is None:
                nodes[at].least = conv
        (nodes[at].beyond if conv in more else nodes[at].ends).append(conv)
    return nodes


def _families(rows: DataFrame) -> DataFrame:
    """Nodes of all families (``NODES``) from rows of ``turns`` with a column ``more``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(NODES))

    def build(key: tuple, first: pa.Table, others: pa.Table) -> pa.Table:
        base, members = key[0].as_py(), []
        for part in (first, others):
            conv, turn, digest, words, more = (part.column(c).to_pylist() for c in ("conv_id", "turn", "key", "words", "more"))
            members += [(c, t is not None, t or 0, d, w, m) for c, t, d, w, m in zip(conv, turn, digest, words, more, strict=True)]
        trie = family_trie(base, members)
        columns = [
            [base] * len(trie),
            range(len(trie)),
            [x.up for x in trie],
            [x.node.to_bytes(16) for x in trie],
            [x.least for x in trie],
            [x.depth for x in trie],
            [x.n for x in trie],
            [x.words for x in trie],
            [bool(x.children or x.beyond) for x in trie],
            [",".join(map(str, x.ends)) for x in trie],
            [x.beyond for x in trie],
        ]
        return pa.table([pa.array(v, type=f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    is_base = F.col("conv_id") == F.col("base")
    return _cogrouped(rows.where(is_base), rows.where(~is_base), build, NODES)


def _cogrouped(one: DataFrame, other: DataFrame, make: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Cogroup by base two tables that may come from one: the other's columns get new names for the planner."""
    other = other.select(*[F.col(c).alias(c) for c in other.columns])
    return one.groupBy("base").cogroup(other.groupBy("base")).applyInArrow(make, schema)


def _lanes(hexed: Column) -> list[Column]:
    """A 128-bit number in hexadecimal as four numbers of 32 bits, the highest first."""
    return [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _joined(lanes: list[Column]) -> Column:
    """Sums of lanes as 16 bytes, what exceeds 128 bits dropped."""
    out, carry = [], F.lit(0).cast("long")
    for lane in reversed(lanes):
        total = lane + carry
        out.append(F.lpad(F.hex(total % (1 << 32)), 8, "0"))
        carry = F.shiftright(total, 32)
    return F.unhex(F.concat(*reversed(out)))


def _chains(numbered: DataFrame, families: DataFrame) -> DataFrame:
    """node, conv_id, depth, words, before (words of the chain above), last: a row for each turn beyond the
    first piece, numbered by ``pos``; each starts behind the node where its family's trie leaves it."""
    lanes = ["l0", "l1", "l2", "l3"]
    left = families.where(F.size("beyond") > 0).select(F.explode("beyond").alias("_c"), F.col("depth").alias("_depth"), *[x.alias(f"_{n}") for x, n in zip(_lanes(F.hex("node")), lanes, strict=True)])
    rows = numbered.where(F.col("pos") > PIECE).join(left, F.col("conv_id") == F.col("_c"))
    depth = (F.col("_depth") + F.col("pos") - PIECE).cast("int")
    hexed = F.sha2(F.concat_ws(":", F.lower(F.hex("key")), depth.cast("string")), 256)
    rows = rows.select(
        "conv_id", "pos", (F.col("pos") == F.col("n")).alias("last"), depth.alias("depth"), "words", F.floor((F.col("pos") - 1) / PIECE).alias("piece"),
        *[x.alias(n) for x, n in zip(_lanes(hexed), lanes, strict=True)], *[f"_{n}" for n in lanes],
    )
    rows = materialize(rows, "chains")
    # sums of the pieces before each piece: a conversation's pieces are few
    pieces = rows.groupBy("conv_id", "piece").agg(*[F.sum(c).alias(c) for c in [*lanes, "words"]])
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.select(
        F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"sum_{c}") for c in [*lanes, "words"]]
    )
    upto = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *[F.sum(c).over(upto).alias(f"run_{c}") for c in [*lanes, "words"]])
    both = run.join(sums, (F.col("conv_id") == F.col("_c")) & (F.col("piece") == F.col("_p")))
    node = _joined([F.col(f"_{n}") + F.col(f"sum_{n}") + F.col(f"run_{n}") for n in lanes])
    return both.select(node.alias("node"), "conv_id", "depth", "words", (F.col("sum_words") + F.col("run_words") - F.col("words")).alias("before"), "last")


def _pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``turns`` for the families, with ``more``, and all turns of longer conversations, numbered."""
    long = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > PIECE), "long-conversations")
    if long.isEmpty():
        return rows.withColumn("more", F.lit(False)), None
    some = rows.join(long, "conv_id", "left_semi")
    each = in_order(some, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), name="_at")
    first = each.groupBy("conv_id").agg(F.min("_at").alias("_first")).join(long, "conv_id")
    numbered = each.join(first, "conv_id").withColumn("pos", F.col("_at") - F.col("_first") + 1).drop("_at", "_first")
    numbered = materialize(numbered, "numbered-turns")
    short = rows.join(long, "conv_id", "left_anti").withColumn("more", F.lit(False))
    start = numbered.where(F.col("pos") <= PIECE).withColumn("more", F.lit(True))
    return materialize(short.unionByName(start.select(short.columns)), "family-turns"), numbered


ADDED = "node binary, conv_id bigint, depth int, n bigint, saved bigint, leaves bigint, children bigint, up binary"


def _added(families: DataFrame, answers: DataFrame) -> DataFrame:
    """What each family adds to the nodes it has (``ADDED``).

    ``answers`` says of conversations from what depth on they own their path (null: nothing of
    it), the depth of the leaf they own (null: none), and the words that they add beyond the family's trie.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(ADDED))

    def add(key: tuple, nodes: pa.Table, told: pa.Table) -> pa.Table:
        rows = sorted(nodes.to_pylist(), key=itemgetter("place"))
        owns = {r["conv_id"]: r for r in told.to_pylist()}
        saved, leaves, children, ups = ([0] * len(rows) for _ in range(4))
        for r in reversed(rows):  # children come after their parents
            at, up, depth = r["place"], r["up"], r["depth"]
            mine = owns.get(r["conv_id"])
            owned = mine is not None and mine["since"] is not None and mine["since"] <= depth
            saved[at] += r["words"] * (r["n"] - owned)
            leaves[at] += owned and mine["leaf"] == depth
            for conv in r["beyond"]:
                his = owns[conv]
                saved[at] += his["beyond_words"]
                leaves[at] += his["leaf"] is not None and his["leaf"] > depth
                children[at] += his["since"] is not None and his["since"] <= depth + 1
            ups[at] = rows[up]["node"] if owned and depth and mine["since"] == depth else None
            if up >= 0:
                saved[up] += saved[at]
                leaves[up] += leaves[at]
                children[up] += owned
        columns = [[r[c] for r in rows] for c in ("node", "conv_id", "depth", "n")] + [saved, leaves, children, ups]
        return pa.table([pa.array(v, type=f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    nodes = families.select("base", "place", "up", "node", "conv_id", "depth", "n", "words", "beyond")
    return _cogrouped(nodes, answers, add, ADDED)


def _ends(families: DataFrame, chains: DataFrame | None) -> DataFrame:
    """node, ends_sha256: digest of the ids that end at a node, for nodes where one does."""
    ends = families.where("ends <> ''").select("node", "base", "ends")
    if chains is not None:
        base = F.col("conv_id") - F.col("conv_id") % FAMILY
        more = chains.where("last").groupBy("node", base.alias("base")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ends"))
        ends = ends.unionByName(more)
    parts = ends.groupBy("node", (F.col("base") - F.pmod(F.col("base"), F.lit(FAMILY * BLOCK))).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda s: s["ends"]), ",").alias("ids")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        made: tuple[list, list] = ([], [])
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name == node:
                    digest.update(b"," + ids.as_py().encode())
                    continue
                if digest:
                    made[0].append(node)
                    made[1].append(digest.hexdigest())
                node, digest = name, hashlib.sha256(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.binary()), pa.array(made[1], pa.string())], names=["node", "ends_sha256"])
            made = ([], [])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    dealt = parts.repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return dealt.mapInArrow(tidied(digests), "node binary, ends_sha256 string")


@scoped("conversation-trie")
def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    ship(conversations.sparkSession)
    rows, numbered = _pieces(turns(conversations))
    families = materialize(_families(rows), "family-nodes")
    seen = families.select("node", "conv_id", "depth", "goes_on")
    chains = None
    if numbered is not None:
        chains = materialize(_chains(numbered, families), "chain-nodes")
        seen = seen.unionByName(chains.select("node", "conv_id", "depth", (~F.col("last")).alias("goes_on")))
    # first merge: who owns a node, and whether it is a leaf
    merged = seen.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("goes_on").alias("goes_on"))
    answers = merged.groupBy("conv_id").agg(F.min("depth").alias("since"), F.max(F.when(~F.col("goes_on"), F.col("depth"))).alias("leaf"))
    answers = answers.withColumn("beyond_words", F.lit(0).cast("long"))
    if chains is not None:
        asked = materialize(answers, "owners").drop("beyond_words").withColumnRenamed("conv_id", "_c")
        lengths = chains.join(asked, F.col("conv_id") == F.col("_c"), "left")
        shared = F.col("since").isNull() | (F.col("depth") < F.col("since"))
        beyond = materialize(lengths.groupBy("conv_id").agg(F.sum(F.when(shared, F.col("words")).otherwise(0)).alias("beyond_words")), "beyond")
        answers = asked.join(beyond, F.col("conv_id") == F.col("_c"), "full").select(
            F.coalesce("conv_id", "_c").alias("conv_id"), "since", "leaf", F.coalesce("beyond_words", F.lit(0).cast("long")).alias("beyond_words")
        )
    added = _added(families, answers.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY))
    if chains is not None:
        all_told = lengths.join(beyond.withColumnRenamed("conv_id", "_b"), F.col("conv_id") == F.col("_b"))
        above = chains.select(F.col("conv_id").alias("_a"), (F.col("depth") + 1).alias("_d"), F.col("node").alias("_up"))
        above = above.unionByName(families.where(F.size("beyond") > 0).select(F.explode("beyond").alias("_a"), (F.col("depth") + 1).alias("_d"), F.col("node").alias("_up")))
        heads = all_told.where(F.col("since") == F.col("depth")).join(above, (F.col("conv_id") == F.col("_a")) & (F.col("depth") == F.col("_d")))
        count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
        chain = all_told.select(
            "node", "conv_id", "depth", F.lit(1).cast("long").alias("n"), F.greatest(F.lit(0).cast("long"), F.col("beyond_words") - F.col("before")).alias("saved"),
            F.col("leaf").isNotNull().cast("long").alias("leaves"), count(~F.col("last") & (F.col("since") <= F.col("depth") + 1)).alias("children"), F.lit(None).cast("binary").alias("up"),
        )
        none = F.lit(0).cast("long")
        ups = heads.select("node", "conv_id", "depth", none.alias("n"), none.alias("saved"), none.alias("leaves"), none.alias("children"), F.col("_up").alias("up"))
        added = added.unionByName(chain).unionByName(ups)
    # second merge: sums over the families
    nodes = added.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("up").alias("up"), *[F.sum(c).alias(c) for c in ("n", "saved", "leaves", "children")]
    )
    nodes = materialize(nodes, "trie-nodes")
    # the parent of a node is its owner's too, but at the head of the part that the owner owns
    parents = nodes.select(F.col("node").alias("_node"), F.col("conv_id").alias("parent"))
    heads = nodes.where(F.col("up").isNotNull()).join(parents, F.col("up") == F.col("_node")).drop("up", "_node")
    others = nodes.where(F.col("up").isNull()).withColumn("parent", F.when(F.col("depth") > 0, F.col("conv_id"))).drop("up")
    ends = _ends(families, chains).withColumnRenamed("node", "_n")
    whole = heads.unionByName(others).join(ends, F.col("node") == F.col("_n"), "left")
    return whole.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
