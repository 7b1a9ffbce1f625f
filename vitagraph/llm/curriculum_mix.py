"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule w(t) over training time t in [0, 1]; the integral of the
schedule, scaled to the source's target, is its cumulative token demand D(t).  Documents of
a source are laid out in a fixed pseudo-random order; the word offset c of a document (in
its r-th pass: c + r * source size) is a demand, and inverting D at it gives the training
position.  Range-sorting by position interleaves all sources as the schedules say.

A schedule is a table (source, t, weight) of knots between which the weight is linear, and
constant before the first and after the last.  Its integral is piecewise quadratic, and is
inverted within the piece that the demand falls into.  Sources without knots get the default:
the heaviest start with 1.5 times their mean weight and end with 0.5 times, the next keep it,
the lightest rise from 0.5 to 1.5 times (by rank, repeating like the weights of the targets).

A pass over a document is taken when the middle of its words lies before the target, so a
source misses its target by at most half a document.  Targets never exceed ``cap`` times
the source, so no document is taken more than ``cap`` times.

Offsets need a running sum within each source.  A source may hold a third of all rows, so
the sum is taken in three levels: by row within a bucket of one source, by bucket within a
group of buckets, by group within the source.  No window holds more than a bucket's rows
or ``FAN`` sums, whatever a source's size.  Rows that are equal in id, source and text are
one row of the layout, with a number of copies that lie one after another.

Edge cases: a null text has size 0; a null source is a source of its own, ordered last;
null and repeated ids are spread by their texts; an empty table gives an empty result.
Sources whose documents hold no word have target 0.  Knots with a null, non-finite or negative
weight or a t outside [0, 1] are left out; of knots at one t the greatest weight counts; a schedule
whose integral is 0 is as good as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows of a bucket, on average, and buckets of a group.
BUCKET_ROWS = 2_000
FAN = 1_000
#: Copies of one row that are dealt to a task.
COPIES = 100_000


def targets(sizes: DataFrame) -> DataFrame:
    """Target of each source: ``sizes`` has a row (src, source_size) for each source.

    Shares by weight, capped at CAP times the source, the excess going to the rest by
    weight.  Sources are capped in the order of CAP * size / weight, so the common factor
    of the uncapped ones follows from running sums; there is a row for each source only.
    """
    ranked = sizes.withColumn("rk", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rk") - 1) % len(WEIGHTS) + 1).cast("long")
    ranked = ranked.select("src", "source_size", "rk", weight.alias("w"))
    # exact order of source_size / w: cross-multiplied by the least common multiple of the weights
    level = F.col("source_size") * (10 / F.col("w")).cast("long")
    by_level = Window.orderBy("level", "rk")
    whole = Window.partitionBy()
    run = (
        ranked.withColumn("level", level)
        .withColumn("cap_sum", F.sum(CAP * F.col("source_size")).over(by_level))
        .withColumn("w_left", F.sum("w").over(whole) - F.sum("w").over(by_level))
        .withColumn("total", F.sum("source_size").over(whole))
    )
    # source k is capped if, with all before it capped, its share exceeds its cap
    before = F.col("cap_sum") - CAP * F.col("source_size")
    share_w = F.col("w_left") + F.col("w")
    capped = (F.col("total") - before) * F.col("w") > CAP * F.col("source_size") * share_w
    run = run.withColumn("capped", capped)
    left = F.col("total") - F.sum(F.when(F.col("capped"), CAP * F.col("source_size")).otherwise(0)).over(whole)
    left_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(whole)
    target = F.when(F.col("capped"), (CAP * F.col("source_size")).cast("double")).otherwise(
        (left * F.col("w")).cast("double") / left_w.cast("double")
    )
    return run.select("src", "source_size", "rk", target.alias("target"))


def pieces(sources: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """src, ``pieces`` (t0, t1, w0, w1, and the integral before, all as parts of a schedule whose integral is 1).

    ``sources`` has a row (src, rk) for each source, so windows here hold the knots of one source.
    """
    slope = -0.5 + 0.5 * ((F.col("rk") - 1) % len(WEIGHTS))
    default = F.array(F.struct(F.lit(0.0).alias("t"), (1 - slope).alias("w")), F.struct(F.lit(1.0).alias("t"), (1 + slope).alias("w")))
    known = sources.select("src", default.alias("knots"))
    if schedule is not None:
        t, w = F.col("t").cast("double"), F.col("weight").cast("double")
        fine = schedule.where(t.between(0, 1) & (w >= 0) & (w < float("inf")))
        fine = fine.groupBy(F.col("source").cast("string").alias("_src"), t.alias("t")).agg(F.max(w).alias("w"))
        given = fine.groupBy("_src").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("given"))
        given = given.where(F.exists("given", lambda k: k["w"] > 0))
        known = known.join(given, F.col("src").eqNullSafe(F.col("_src")), "left").select("src", F.coalesce("given", "knots").alias("knots"))
    # constant up to the ends of time
    first, last = F.element_at("knots", 1), F.element_at("knots", -1)
    at = lambda t, w: F.array(F.struct(F.lit(t).alias("t"), w.alias("w")))
    ends = F.concat(at(0.0, first["w"]), F.col("knots"), at(1.0, last["w"]))
    knots = known.select("src", F.posexplode(ends).alias("n", "k")).select("src", "n", "k.t", "k.w")
    order = Window.partitionBy("src").orderBy("n")
    knots = knots.withColumn("t0", F.lag("t").over(order)).withColumn("w0", F.lag("w").over(order)).where("t > t0")
    area = (F.col("t") - F.col("t0")) * (F.col("w0") + F.col("w")) / 2
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    knots = knots.withColumn("area", area).withColumn("upto", F.sum("area").over(upto))
    whole = knots.groupBy(F.col("src").alias("_src")).agg(F.sum("area").alias("whole"))
    knots = knots.join(whole, F.col("src").eqNullSafe(F.col("_src"))).where("area > 0")
    share = lambda c: (F.col(c) / F.col("whole")).alias(c)
    before = ((F.col("upto") - F.col("area")) / F.col("whole")).alias("before")
    piece = F.struct(before, "t0", F.col("t").alias("t1"), share("w0"), share("w"))
    return knots.groupBy("src").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def position(demand: Column, target: Column, parts: Column) -> Column:
    """The time t at which ``D(t) = demand``: the inverse of the integral, in the piece that the demand falls into."""
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), demand / target))
    p = F.element_at(F.filter(parts, lambda k: k["before"] <= y), -1)
    rest, slope = y - p["before"], (p["w"] - p["w0"]) / (p["t1"] - p["t0"])
    # rest = w0 s + slope s^2 / 2, solved for s without cancellation
    root = F.sqrt(F.greatest(F.lit(0.0), p["w0"] * p["w0"] + 2 * slope * rest))
    s = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (p["w0"] + root))
    return F.least(p["t1"], p["t0"] + s)


def plan(docs: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, source, content (hash of the text), copies, size, source_size, target,
    taken, passes, positions.

    ``positions`` holds the training position of each pass that is taken; ``copies`` is the number of rows
    that are equal in doc_id, source and content.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("src"),
        n_words(F.col("text")).alias("size"),
        F.md5("text").alias("content"),
    )
    rows = rows.groupBy("doc_id", "src", "size", "content").agg(F.count("*").alias("copies"))
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("content", F.lit(""))))
    rows = materialize(rows.withColumn("h", h), "mix-sizes")
    n_buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    groups = max(1, -(-n_buckets // FAN))
    # h is uniform hexadecimal: its first 12 digits cut [0, 1) into equal ranges, kept in the order of h
    slot = F.conv(F.substring("h", 1, 12), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(slot / F.lit(16.0**12) * n_buckets).cast("long"))
    rows = rows.withColumn("grp", F.floor(F.col("bucket") * groups / n_buckets).cast("long"))
    rows = rows.withColumn("words", F.col("size") * F.col("copies"))

    sums = rows.groupBy("src", "grp", "bucket").agg(F.sum("words").alias("s"))
    by_group = sums.groupBy("src", "grp").agg(F.sum("s").alias("gs"))
    per_source = targets(by_group.groupBy("src").agg(F.sum("gs").alias("source_size")))
    curves = pieces(per_source.select("src", "rk"), schedule).withColumnRenamed("src", "_psrc")
    per_source = per_source.join(curves, F.col("src").eqNullSafe(F.col("_psrc"))).drop("_psrc")
    upto = lambda *part: Window.partitionBy(*part[:-1]).orderBy(part[-1]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    group_base = by_group.select(
        "src", "grp", (F.sum("gs").over(upto("src", "grp")) - F.col("gs")).alias("g0")
    )
    bucket_base = sums.select(
        F.col("src").alias("bsrc"),
        F.col("grp").alias("bgrp"),
        F.col("bucket").alias("bb"),
        (F.sum("s").over(upto("src", "grp", "bucket")) - F.col("s")).alias("b0"),
    )
    base = (
        bucket_base.join(group_base, F.col("bsrc").eqNullSafe(F.col("src")) & (F.col("bgrp") == F.col("grp")))
        .drop("src", "grp")
        .join(per_source, F.col("bsrc").eqNullSafe(F.col("src")))
        .select("bsrc", "bb", (F.col("b0") + F.col("g0")).alias("base"), "source_size", "target", "pieces")
    )
    in_bucket = Window.partitionBy("src", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("local", F.sum("words").over(in_bucket) - F.col("words"))
    placed = local.join(base, F.col("src").eqNullSafe(F.col("bsrc")) & (F.col("bucket") == F.col("bb")))
    # one row for each copy; very many copies are first dealt out in parts
    copies = F.col("copies")
    one = F.sequence(F.lit(0).cast("long"), copies - 1)
    if rows.where(copies > COPIES).limit(1).count():
        parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / COPIES))))
        placed = parts.repartition("src", "h", "part")
        one = F.sequence(F.col("part") * COPIES, F.least(copies, (F.col("part") + 1) * COPIES) - 1)
    placed = placed.withColumn("copy", F.explode(one))
    start = F.col("local") + F.col("base") + F.col("copy") * F.col("size")
    # passes r = 0, 1, .. whose middle, start + size / 2 + r * source_size, lies before the target
    passes = F.when(F.col("size") == 0, F.lit(0)).otherwise(
        F.greatest(
            F.lit(0),
            F.least(
                F.lit(CAP),
                F.ceil((2 * F.col("target") - 2 * start - F.col("size")) / (2 * F.col("source_size"))),
            ),
        )
    ).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("start", start)
    where = F.transform(
        F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes").cast("int") - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda r: position(
            F.col("start").cast("double") + F.col("size") / 2.0 + r * F.col("source_size"), F.col("target"), F.col("pieces")
        ),
    )
    return placed.select(
        "doc_id",
        F.col("src").alias("source"),
        "content",
        "copies",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("passes")).alias("taken"),
        "passes",
        where.alias("positions"),
    )


def mix(docs: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """The documents in training order: each row as often as it is taken, range-sorted by position.

    Rows that share doc_id, source and content are copies of each other: the positions of all of
    them go to one, and the others give none.  Only rows that have copies are counted off, and of
    these each task hands on one at most; all texts travel to the plan once, and to their places once.
    """
    names = docs.columns
    key = ("doc_id", "source", "content")
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.col("doc_id").cast("long").alias("_doc_id"),
        F.col("source").cast("string").alias("_source"),
        F.md5("text").alias("_content"),
    )
    right = plan(docs, schedule).where(F.size("positions") > 0).select(*key, "copies", "positions")
    right = materialize(right, "mix-plan")
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in key]
    out = left.join(right.where("copies = 1"), same).select("_row", F.explode("positions").alias("_at"))
    copied = right.where("copies > 1")
    if copied.limit(1).count():
        again = left.join(copied.select(*key).distinct(), same, "left_semi")
        nth = F.row_number().over(Window.partitionBy("_doc_id", "_source", "_content").orderBy(F.xxhash64("_row")))
        one = again.withColumn("_nth", nth).where("_nth = 1")
        out = out.unionByName(one.join(copied, same).select("_row", F.explode("positions").alias("_at")))
    return out.repartitionByRange("_at").sortWithinPartitions("_at").select("_row.*")
