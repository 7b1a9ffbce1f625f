"""A graph whose search tables follow its writes.

What is made of a graph's texts (term counts, vectors) lies in a folder as a base and the deltas of
writes since, each a generation with a number.  A delta holds the owners that a write touched and their rows
as they are after it: none for an owner that is gone, so that a touched owner without rows is a
tombstone.  To read is to merge: of each owner the rows of the last generation that touched it count.  When
deltas have become many, or touch a large part of the base, the merge is written as the base of a new generation.

A generation counts from when its folder is complete, and a base makes all before it void, so a write
that fails half-way leaves what was there; its folder's number is used again.

A node's name is part of the texts of the claims that refer to it: to touch it is to touch these.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import Folder, discard, exists, folders
from . import search, writes

#: Deltas beyond this number, or that touch more than this share of the base's owners, are merged.
MOST_DELTAS, SHARE = 8, 0.25
OWNER = ["owner_type", "owner_id"]


#: Changed nodes that are broadcast at most.
CHANGED = 200_000


class LiveTable:
    """Rows by owner (owner_type, owner_id), one for each at most, made by ``make`` from rows of a corpus."""

    def __init__(self, path: str, make: Callable[[DataFrame], DataFrame], base: DataFrame, written: bool = False):
        """``base``: the rows as they are now; a table that has been ``written`` is read where it is, until the first merge."""
        self.spark, self.path, self.make, self.schema = base.sparkSession, path, make, base.schema
        self._given = base if written else None
        if not written:
            base.write.mode("overwrite").parquet(f"{path}/base-0")

    def _generations(self) -> tuple[int, list[int]]:
        """The number of the last complete base, and of the complete deltas after it."""
        complete = [n for n in folders(self.spark, self.path) if exists(self.spark, f"{self.path}/{n}/_SUCCESS" if n.startswith("base") else f"{self.path}/{n}/rows/_SUCCESS")]
        number = lambda kind: [int(n.split("-")[1]) for n in complete if n.startswith(kind)]
        base = max(number("base"), default=0)
        return base, sorted(n for n in number("delta") if n > base)

    def _read(self, folder: str, schema) -> DataFrame:
        if folder == "base-0" and self._given is not None:
            return self._given
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def each(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``f`` makes of the rows of each generation, with its number ``_n``; ``standing`` tells which count."""
        base, deltas = self._generations()
        parts = [(base, f"base-{base}"), *((n, f"delta-{n}/rows") for n in deltas)]
        return reduce(DataFrame.unionByName, [f(self._read(folder, self.schema)).withColumn("_n", F.lit(n)) for n, folder in parts])

    def standing(self, rows: DataFrame, few: bool = False) -> DataFrame:
        """Of rows made by ``each`` those whose owner no later generation touched, without ``_n``; ``few``: against the touched owners, the rows are few."""
        deltas = self._generations()[1]
        if not deltas:
            return rows.drop("_n")
        owners = "owner_type string, owner_id string"
        touched = reduce(DataFrame.unionByName, [self._read(f"delta-{n}/touched", owners).withColumn("_n", F.lit(n)) for n in deltas])
        if few:
            own = rows.select(*[F.col(c).alias(f"_{c}") for c in OWNER]).distinct()
            touched = touched.join(own, [F.col(c) == F.col(f"_{c}") for c in OWNER], "left_semi")
        last = touched.groupBy(*[F.col(c).alias(f"_{c}") for c in OWNER]).agg(F.max("_n").alias("_last"))
        return rows.join(last, [*[F.col(c) == F.col(f"_{c}") for c in OWNER], F.col("_n") < F.col("_last")], "left_anti").drop("_n")

    def rows(self) -> DataFrame:
        return self.standing(self.each(lambda df: df))

    def change(self, touched: DataFrame, rows: DataFrame | None) -> None:
        """Take in a write: the owners it ``touched``, and the corpus ``rows`` of those that are there after it, if any can be."""
        base, deltas = self._generations()
        n = max([base, *deltas]) + 1
        touched.select(OWNER).distinct().write.mode("overwrite").parquet(f"{self.path}/delta-{n}/touched")
        # the rows come last: with them the generation is complete
        made = self.spark.createDataFrame([], self.schema) if rows is None else self.make(rows).select(self.schema.names)
        made.write.mode("overwrite").parquet(f"{self.path}/delta-{n}/rows")
        if len(deltas) + 1 > MOST_DELTAS or self._touched([*deltas, n]) > SHARE * self._read(f"base-{base}", self.schema).count():
            self.compact()

    def _touched(self, deltas: list[int]) -> int:
        return sum(self._read(f"delta-{n}/touched", "owner_type string, owner_id string").count() for n in deltas)

    def compact(self) -> None:
        """Write the merge as a new base, and delete what it makes void."""
        base, deltas = self._generations()
        if not deltas:
            return
        n = deltas[-1] + 1
        self.rows().write.mode("overwrite").parquet(f"{self.path}/base-{n}")
        self._given = None
        for name in [f"base-{base}", *(f"delta-{k}" for k in deltas)]:
            discard(Folder(self.spark, f"{self.path}/{name}"))


class Store:
    """A graph and its search tables; every write goes to both."""

    def __init__(self, g: Graph, path: str, terms: DataFrame | None = None, vectors: DataFrame | None = None):
        """``terms``: the term counts as they are, if they have been written; vectors are kept only if given."""
        self.graph, self.path, self._writes = g, path, 0
        self.terms = LiveTable(f"{path}/terms", search.build_index, search.build_index(search.corpus(g)) if terms is None else terms, terms is not None)
        self.vectors = LiveTable(f"{path}/vectors", search.embeddings, vectors) if vectors is not None else None

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        """Written to the store's folder, as what comes after reads it often."""
        path = f"{self.path}/{label}-{self._writes}"
        df.write.mode("overwrite").parquet(path)
        return self.graph.node.sparkSession.read.schema(df.schema).parquet(path)

    def _follow(self, after: Graph, nodes: DataFrame | None = None, claims: DataFrame | None = None, gone: bool = False) -> None:
        """``nodes`` or ``claims`` (id): what a write has changed, made or deleted; ``gone``: nothing of them is there."""
        self._writes += 1
        changed = self._kept((claims if nodes is None else nodes).select("id").distinct(), "changed").select(F.col("id").alias("_changed"))
        owners = lambda df, kind, c: df.select(F.lit(kind).alias("owner_type"), F.col(c).alias("owner_id"))
        its = lambda df: df.join(changed, F.col("id") == F.col("_changed"), "left_semi")
        if nodes is not None:
            after = after.with_(node=self._kept(after.node, "node"))
            near = self._kept(self._near(after.claim, changed).select(*search.CLAIM), "near")
            touched = owners(changed, "node", "_changed").unionByName(owners(near, "claim", "id"))
            rows = search.node_corpus(its(after.node)).unionByName(search.claim_corpus(near, after.node))
        else:
            touched = owners(changed, "claim", "_changed")
            rows = None if gone else search.claim_corpus(its(after.claim), after.node)
        for table in (self.terms, self.vectors):
            if table is not None:
                table.change(touched, rows)
        self.graph = after

    def _near(self, claims: DataFrame, changed: DataFrame) -> DataFrame:
        """Claims that refer to nodes which have ``_changed``."""
        ends = ("subject", "object", "population")
        if changed.count() > CHANGED:
            each = claims.select(F.col("id").alias("_claim"), F.explode(F.array_distinct(F.array(*ends))).alias("_end"))
            near = each.join(changed, F.col("_end") == F.col("_changed"), "left_semi").select("_claim").distinct()
            return claims.join(near, F.col("id") == F.col("_claim"), "left_semi")
        out = claims
        for c in ends:
            out = out.join(F.broadcast(changed.select(F.col("_changed").alias(f"_{c}"))), F.col(c) == F.col(f"_{c}"), "left")
        return out.where(" or ".join(f"_{c} is not null" for c in ends)).drop(*[f"_{c}" for c in ends])

    def _checked(self, made: tuple[Graph, DataFrame], kind: str) -> DataFrame:
        after, results = made
        self._follow(after, **{kind: results.where("status_code = 200").select("id")})
        return results

    def create_nodes(self, rows: DataFrame) -> DataFrame:
        return self._checked(writes.create_nodes(self.graph, rows), "nodes")

    def update_nodes(self, rows: DataFrame) -> DataFrame:
        return self._checked(writes.update_nodes(self.graph, rows), "nodes")

    def delete_nodes(self, ids: list[str] | DataFrame) -> DataFrame:
        return self._checked(writes.delete_nodes(self.graph, ids), "nodes")

    def create_claims(self, rows: DataFrame) -> DataFrame:
        return self._checked(writes.create_claims(self.graph, rows), "claims")

    def update_claims(self, rows: DataFrame) -> DataFrame:
        return self._checked(writes.update_claims(self.graph, rows), "claims")

    def delete_claims(self, ids: list[str] | DataFrame) -> None:
        gone = ids if isinstance(ids, DataFrame) else self.graph.node.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        self._follow(writes.delete_claims(self.graph, gone), claims=gone, gone=True)

    def add_alias(self, id: str, alias: str) -> None:
        self._follow(writes.add_alias(self.graph, id, alias), nodes=self.graph.node.where(F.col("id") == id).select("id"))
