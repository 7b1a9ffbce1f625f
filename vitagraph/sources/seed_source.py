"""Graph seeds as a data source: ``spark.read.format("graph_seed").option("table", "nodes").load(folder)``.

A seed is a JSON file with the lists nodes, claims, evidence and contradictions; a large one is many such
files in a folder.  Each file is a partition, read by one task, and the tables are the lists over all
files, with ``ord``, an entry's place: by the file's path, then by place in the file.  Equality and membership
tests on an entry's text fields are pushed to the reader, so that entries that fail them never become rows; Spark
pushes filters where ``spark.sql.python.filterPushdown.enabled`` is set.  Paths are URIs of any store that
Arrow's file systems know.

Edge cases: fields that are absent or null are null, lists of texts too; a text field that holds something
else is an error, as a seed is written by people; entries that are no objects are left out; a file without
a list has no entry of it; a folder without files has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from .. import schema
from ..graph import Graph, conform, vocabulary
from .seed import GRAPH_FILE

NAME, TABLES = "graph_seed", ("nodes", "claims", "evidence", "contradictions")
#: Places within a file that are told apart in ``ord``.
PER_FILE = 1 << 32
#: Entries of a file that is written, about.
MOST_ENTRIES = 50_000


def _fields(table: str) -> list[T.StructField]:
    return GRAPH_FILE[table].dataType.elementType.fields


def _store(path: str) -> tuple:
    """A file system and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if path.startswith("file:") or "://" in path else f"file://{path}")


def _files(path: str) -> list[str]:
    """The files below a folder, in order of their paths, but those whose names start as hidden ones do; or the one file."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return [path.rstrip("/") + f[len(at.rstrip("/")) :] for f in sorted(found)]


class SeedFile(InputPartition):
    def __init__(self, place: int, path: str):
        super().__init__(place)
        self.path = path


class SeedReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        texts = {f.name for f in _fields(self.table) if isinstance(f.dataType, T.StringType)}
        for one in filters:
            column = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if column in texts and isinstance(one, (EqualTo, EqualNullSafe)) and one.value is not None:
                self.tests.append((column, frozenset([one.value])))
            elif column in texts and isinstance(one, In):
                self.tests.append((column, frozenset(v for v in one.value if v is not None)))
            else:
                yield one

    def partitions(self) -> list[SeedFile]:
        return [SeedFile(k, f) for k, f in enumerate(_files(self.path))]

    def read(self, partition: SeedFile | None) -> Iterator[tuple]:
        if partition is None:  # no file at all
            return
        store, at = _store(partition.path)
        with store.open_input_stream(at) as stream:
            entries = json.loads(stream.read()).get(self.table) or []
        fields = _fields(self.table)
        for k, entry in enumerate(entries):
            if isinstance(entry, dict) and all(entry.get(c) in values for c, values in self.tests):
                yield (partition.value * PER_FILE + k, *(self._value(entry.get(f.name), f) for f in fields))

    def _value(self, value, field: T.StructField):
        if value is None:
            return None
        if isinstance(field.dataType, T.DoubleType):
            return float(value)
        if isinstance(value, str) != isinstance(field.dataType, T.StringType):
            raise ValueError(f"{self.table}: {field.name} is {value!r}")
        return value


class SeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "nodes")
        if table not in TABLES:
            raise ValueError(f"no such table of a seed: {table}; there are {', '.join(TABLES)}")
        return table

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("ord", T.LongType()), *_fields(self._table())])

    def reader(self, schema: T.StructType) -> SeedReader:
        return SeedReader(self.options["path"], self._table())


def seed_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A seed's entries as they are; filters on text fields are pushed."""
    from ..runtime import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeedSource)
    return spark.read.format(NAME).option("table", table).load(path)


def _entries(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Of equal ids the last content stands at the first place."""
    rows = seed_table(spark, path, table)
    rows = rows.select("ord", F.struct(*[c for c in rows.columns if c != "ord"]).alias("e"))
    best = rows.groupBy(F.col("e.id").alias("_id")).agg(F.min("ord").alias("ord"), F.max_by("e", "ord").alias("e"))
    return best.select("ord", "e.*")


def load_seeds(spark: SparkSession, path: str) -> Graph:
    """The graph of all seed files of a folder; of one file, as ``load_graph``."""
    claims = _entries(spark, path, "claims")
    listed = claims.select(F.col("id").alias("claim"), F.posexplode("evidence").alias("ev_ord", "evidence"))
    evidence = _entries(spark, path, "evidence")
    place = listed.groupBy("evidence").agg(F.min("ev_ord").alias("ev_ord"))
    evidence = evidence.drop("ord").join(place, F.col("id") == F.col("evidence"), "left").drop("evidence")
    return Graph(
        conform(_entries(spark, path, "nodes"), schema.NODE),
        conform(claims.drop("evidence"), schema.CLAIM),
        conform(evidence, schema.EVIDENCE),
        conform(listed, schema.LISTED),
        conform(_entries(spark, path, "contradictions"), schema.RELATION),
        vocabulary(spark),
    )


def write_seeds(g: Graph, path: str, files: int, most: int = MOST_ENTRIES) -> None:
    """The graph as a folder of ``files`` seed files, each with the nodes, claims, evidence and contradictions of a part of the ids.

    There are more files if each would hold more than about ``most`` entries, as a reader takes a file as a whole.
    An entry's place is kept within its file; a claim's evidence goes with the claim.  Files are written line by
    line from sorted rows, so no task holds one.
    """
    spark = g.node.sparkSession
    files = max(files, -(-sum(df.count() for df in (g.node, g.claim, g.evidence, g.relation)) // most))
    listed = g.listed.groupBy(F.col("claim").alias("_claim")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ev_ord", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    claims = g.claim.join(listed, F.col("id") == F.col("_claim"), "left")
    # a file's lines: before each list and at the end what stands between them (kind 0), then its entries (kind 1)
    between = ['{"version":1,', *["],"] * (len(TABLES) - 1), "]}"]
    opens = [F.struct(F.lit(k).alias("t"), F.lit(b + (f'"{TABLES[k]}":[' if k < len(TABLES) else "")).alias("j")) for k, b in enumerate(between)]
    lines = spark.range(files).select(F.col("id").alias("part"), F.explode(F.array(*opens)).alias("l"))
    lines = lines.select("part", "l.t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("o"), "l.j")
    for table, rows, key in (("nodes", g.node, "id"), ("claims", claims, "id"), ("evidence", g.evidence, "claim"), ("contradictions", g.relation, "id")):
        order = F.col("ord") if "ord" in rows.columns else F.col("ev_ord")
        entry = F.struct(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _fields(table)])
        part = F.pmod(F.xxhash64(key), F.lit(files)).alias("part")
        lines = lines.unionByName(rows.select(part, F.lit(TABLES.index(table)).alias("t"), F.lit(1).alias("kind"), order.alias("o"), F.to_json(entry).alias("j")))
    place = ["kind", "o", "j"]
    nth = F.row_number().over(Window.partitionBy("part", "t").orderBy(*place))
    lines = lines.repartition(files, "part").withColumn("value", F.when(nth > 2, F.concat(F.lit(","), "j")).otherwise(F.col("j")))
    lines.sortWithinPartitions("part", "t", *place).select("value", "part").write.partitionBy("part").text(path)
