"""A graph over the star-schema tables: one deterministic mapping."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..graph import Graph, conform, listed_from, load, vocabulary
from ..runtime import exists, keeping, materialize, release, remover, shared_dir, ship, state_of

KINDS = {1: "reduces_risk_of", 2: "improves", 3: "treats", 4: "increases_risk_of", 5: "worsens", 6: "recommends", 7: "is_a"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: dict, key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(table: str, kind: int, prefix: str, type_: str, key: str, name: str, domains: Column | None = None, codes: Column | None = None) -> DataFrame:
        none = F.array().cast("array<string>")
        return read(spark, sf_dir, table).select(
            (F.lit(kind * 10**9) + F.col(key)).cast("long").alias("ord"),
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"),
            F.lit(type_).alias("type"),
            F.col(name).alias("name"),
            (none if domains is None else domains).alias("domains"),
            (none if codes is None else codes).alias("external_ids"),
        )

    brand = F.when(F.col("p_size") <= 25, F.array(F.concat(F.lit("MESH:"), "p_brand"))).otherwise(F.array().cast("array<string>"))
    out = of("region", 0, "rg:", "population", "r_regionkey", "r_name")
    out = out.unionByName(of("nation", 1, "nt:", "mechanism", "n_nationkey", "n_name"))
    out = out.unionByName(of("supplier", 2, "su:", "intervention", "s_suppkey", "s_name"))
    out = out.unionByName(of("part", 3, "pt:", "outcome", "p_partkey", "p_name", F.array(F.lower("p_type")), brand))
    return conform(out, schema.NODE)


#: Suppliers that are broadcast at most.
SUPPLIERS = 500_000


def _claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claims are made of, as keys and codes: rows that are narrow to shuffle.

    Lines move once, by their order, for both their grouping and the join; customers meet the orders, which are fewer.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_shipdate")
    lines = lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("sk"), F.min("l_partkey").alias("pk"), F.min("l_returnflag").alias("rf"), F.max("l_shipdate").alias("shipped")
    )
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("priority"), "o_orderdate")
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "priority", "o_orderdate", "n_regionkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    supplier = F.broadcast(supplier) if supplier.count() <= SUPPLIERS else supplier
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("sk") == F.col("s_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "sk", "pk", "rf", "shipped", "o_orderstatus", "priority", "o_orderdate", "n_regionkey", "s_nationkey")


def claims(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """``ordered``: in order of object and place; rows are written first, so that what the joins shuffled is gone when they are dealt out."""
    rows, number, key = _claim_rows(spark, sf_dir), F.col("l_linenumber"), F.col("l_orderkey")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    place, object_ = key * 10 + number, tag("pt:", "pk")
    if ordered:
        rows = materialize(rows, "claim-rows")
        release(spark)
        rows = rows.repartitionByRange(object_, place).sortWithinPartitions(object_, place)
    out = rows.select(
        place.alias("ord"),
        F.concat(F.lit("cl:"), key.cast("string"), F.lit("-"), number.cast("string")).alias("id"),
        _pick(KINDS, number).alias("type"),
        tag("su:", "sk").alias("subject"),
        object_.alias("object"),
        F.when(key % 2 == 0, tag("rg:", "n_regionkey")).alias("population"),
        F.when(key % 3 == 0, tag("nt:", "s_nationkey")).alias("mechanism"),
        _pick({"A": "increase", "N": "decrease"}, F.col("rf")).alias("direction"),
        _pick({"1": "high", "2": "moderate", "3": "low", "4": "very_low"}, F.col("priority")).alias("certainty"),
        _pick({"F": "curated", "O": "unverified", "P": "needs_refinement"}, F.col("o_orderstatus")).alias("status"),
        F.when((number == 2) & (key % 4 == 0), "usual_care").alias("comparator"),
        F.col("o_orderdate").alias("created_at"),
        F.col("shipped").alias("updated_at"),
    )
    return conform(out, schema.CLAIM)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    place = F.row_number().over(
        Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    )
    claim = F.concat(F.lit("cl:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    quantity = F.col("l_quantity").cast("long")
    designs = F.array(*map(F.lit, schema.DESIGNS))
    out = rows.withColumn("ev_ord", place.cast("long")).select(
        F.concat(claim, F.lit("-e"), F.col("ev_ord").cast("string")).alias("id"),
        claim.alias("claim"),
        "ev_ord",
        F.concat(F.lit("PMID:"), F.col("l_partkey").cast("string")).alias("source_id"),
        F.when(quantity % 9 < 8, F.get(designs, (quantity % 9).cast("int"))).alias("study_design"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("n = "), (quantity * 40).cast("string"))).alias("quote"),
    )
    return conform(out, schema.EVIDENCE)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 1 against line 4 of every fiftieth order, where both are there."""
    keys = read(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 0 and l_linenumber in (1, 4)").select("l_orderkey", "l_linenumber")
    both = keys.groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n")).where("n = 2")
    claim = lambda n: F.concat(F.lit("cl:"), F.col("l_orderkey").cast("string"), F.lit(f"-{n}"))
    out = both.select(
        F.col("l_orderkey").alias("ord"),
        F.concat(F.lit("rel:"), F.col("l_orderkey").cast("string")).alias("id"),
        F.lit("contradicts").alias("type"),
        claim(1).alias("subject_claim"),
        claim(4).alias("object_claim"),
    )
    return conform(out, schema.RELATION)


#: The tables that the graph is made of.
TABLES = ("region", "nation", "supplier", "part", "customer", "orders", "lineitem")
#: By application and folder: the state of the tables that a graph was made of, where it lies, and what deletes it.
_built: dict[tuple[str, str], tuple[str, str, Callable[[], None]]] = {}


def _forget(*keys: tuple[str, str]) -> None:
    """Delete built graphs."""
    for key in keys or list(_built):
        with contextlib.suppress(Exception):  # at the end the application may be gone, and its folder with it
            _built.pop(key)[2]()


atexit.register(_forget)


def graph(spark: SparkSession, sf_dir: str, *only: str) -> Graph:
    """The mapped graph, built once for each application and state of a folder's tables, and read from the shared folder.

    Claims lie in order of their object and evidence in order of its claim, so that lookups by these
    read few row groups.  A build that is gone, or whose tables have changed, is made again.
    ``only``: the graph's tables that a query reads, if not all; others that have not been built are plans.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    now = state_of(spark, *[f"{sf_dir}/{t}.parquet" for t in TABLES])
    if key in _built and (_built[key][0] != now or not exists(spark, f"{_built[key][1]}/node/_SUCCESS")):
        _forget(key)
    if key not in _built:
        path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
        _built[key] = now, path, remover(spark, path)
    path = _built[key][1]
    by = lambda df, *c: df.repartitionByRange(*c).sortWithinPartitions(*c)
    made = {
        "node": lambda: nodes(spark, sf_dir),
        "claim": lambda: claims(spark, sf_dir, ordered="claim" in wanted),
        "evidence": lambda: by(evidence(spark, sf_dir), "claim", "ev_ord"),
        "listed": lambda: by(listed_from(evidence(spark, sf_dir)), "claim", "ev_ord"),
        "relation": lambda: relations(spark, sf_dir),
        "vocab": lambda: vocabulary(spark),
    }
    lack = [name for name in made if not exists(spark, f"{path}/{name}/_SUCCESS")]
    wanted = [name for name in lack if name in ("node", *(only or made))]
    for name in wanted:
        with keeping():
            made[name]().write.mode("overwrite").parquet(f"{path}/{name}")
        if name in ("claim", "evidence", "listed"):
            release(spark)
    return load(spark, path, **{name: made[name]() for name in lack if name not in wanted})


#: Claims that are indexed at a time.
INDEXED = 20_000_000


def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search index of the mapped graph, kept beside it.

    It is made of slices of the claims one after the other, so that what finding their names shuffles is bounded.
    """
    from ..operators import search

    g = graph(spark, sf_dir, "node", "claim")
    slices = max(1, -(-g.claim.count() // INDEXED))
    paths = [f"{_built[spark.sparkContext.applicationId, sf_dir][1]}/terms/{i}-{slices}" for i in range(slices)]
    for i, path in enumerate(paths):
        if not exists(spark, f"{path}/_SUCCESS"):
            claim = g.claim.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == i) if slices > 1 else g.claim
            rows = search.claim_corpus(claim, g.node)
            rows = rows if i else search.node_corpus(g.node).unionByName(rows)
            search.build_index(rows).write.mode("overwrite").option("compression", "zstd").parquet(path)
            release(spark)
    return spark.read.parquet(*paths)


def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("id"),
        F.col("event_type").alias("agent"),
        F.col("user_id").cast("string").alias("claim_id"),
        F.when(F.col("value") >= 5, F.col("event_type")).alias("outcome"),
        F.col("ts").alias("created_at"),
    )
    return conform(out, schema.AGENT_RUN)


def ask_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("id"),
        F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_id") % 7 != 0, (F.floor("value") % 4).cast("int")).alias("num_claims"),
        F.when(F.col("event_id") % 2 != 0, "rejected").alias("gap_status"),
        F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 1000).cast("int")).alias("input_tokens"),
        F.lit(10).alias("output_tokens"),
        F.col("ts").alias("created_at"),
    )
    return conform(out, schema.ASK_LOG)
