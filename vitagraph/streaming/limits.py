"""Sliding-log rate limits over events, in batch and as a stream, and stream tails of logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Accepted requests of one client within the window.
MAX_HITS = 6
WINDOW_MS = 60_000
#: Keys that are remembered at once; beyond, all are forgotten.
MAX_KEYS = 5_000
#: How long after the last event a replay closes.
CLOSING_MS = 10 * 86_400_000


class SlidingLog:
    """Accepts a hit if fewer than ``most`` accepted ones lie within the window before it.

    Rejected hits leave no trace, so at most ``most`` times are remembered.
    """

    def __init__(self, most: int, window_ms: int, times: list[int] | None = None):
        self.most, self.window = most, window_ms
        self.times: deque[int] = deque(times or ())

    def accept(self, at_ms: int) -> bool:
        while self.times and at_ms - self.times[0] >= self.window:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(at_ms)
        return True


def limited(events: DataFrame, most: int = MAX_HITS, window_ms: int = WINDOW_MS) -> DataFrame:
    """key, seq, at_ms, accepted of events (key, seq, at_ms), in order of (at_ms, seq) within a key.

    Rows are dealt by key and streamed in sorted order through each task: a busy key takes
    constant memory, as its state is a handful of times.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = object(), SlidingLog(most, window_ms)
        for batch in batches:
            verdicts = []
            for k, at in zip(batch["key"].tolist(), batch["at_ms"].tolist(), strict=True):
                if k != key:
                    key, log = k, SlidingLog(most, window_ms)
                verdicts.append(log.accept(at))
            yield batch.assign(accepted=verdicts)

    ship(events.sparkSession)
    rows = events.select("key", "seq", F.col("at_ms").cast("long").alias("at_ms"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "seq").mapInPandas(run, f"{kinds}, accepted boolean")


def epochs(events: DataFrame, most_keys: int = MAX_KEYS) -> DataFrame:
    """Events with ``epoch``: how often all keys had been forgotten before an event, in order of (at_ms, seq, key).

    An event that finds more than ``most_keys`` keys remembered clears them all first.  In an epoch that
    starts at one place, a key is new where its event before lies ahead of that place, so the place of the next
    clear is one ordered look at the new keys from there: a small job for each clear, and none where there
    are few keys.
    """
    from pyspark.sql.window import Window

    from ..runtime import in_order, materialize

    rows = in_order(events, F.col("at_ms"), F.col("seq"), F.col("key"), name="place")
    before = F.lag("place").over(Window.partitionBy("key").orderBy("place"))
    rows = materialize(rows.withColumn("_before", F.coalesce(before, F.lit(0))), "event-places")
    starts, at = [1], 1
    while True:
        new = rows.where((F.col("place") >= at) & (F.col("_before") < at)).orderBy("place").select("place").limit(most_keys + 1)
        row = new.agg(F.count("*").alias("n"), F.max("place").alias("last")).first()
        if row["n"] <= most_keys:
            break
        at = row["last"] + 1
        starts.append(at)
    bounds = events.sparkSession.createDataFrame([(k, s, e) for k, (s, e) in enumerate(zip(starts, [*starts[1:], 1 << 62], strict=True))], "epoch long, _from long, _to long")
    if len(starts) == 1:
        return rows.withColumn("epoch", F.lit(0).cast("long")).drop("place", "_before")
    # each event lies in one epoch: sought by blocks of places, not by comparing all
    size = 1 << 16
    spread = bounds.withColumn("_to", F.least("_to", F.lit(starts[-1] + 2 * size))).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))
    last = starts[-1]
    joined = rows.withColumn("_b", F.floor(F.least("place", F.lit(last)) / size)).join(spread, (F.col("_b") == F.col("_block")) & (F.least("place", F.lit(last)) >= F.col("_from")) & (F.least("place", F.lit(last)) < F.col("_to")))
    return joined.drop("place", "_before", "_b", "_block", "_from", "_to")


def limited_in_epochs(events: DataFrame, most: int = MAX_HITS, window_ms: int = WINDOW_MS, most_keys: int = MAX_KEYS) -> DataFrame:
    """As ``limited``, with all keys forgotten when an event finds more than ``most_keys`` of them."""
    rows = epochs(events.select("key", "seq", F.col("at_ms").cast("long").alias("at_ms")), most_keys)
    rows = limited(rows.select(F.struct("epoch", "key").alias("key"), "seq", "at_ms"), most, window_ms)
    return rows.select("key.key", "seq", "at_ms", "accepted")


def limited_stream(events: DataFrame, most: int = MAX_HITS, window_ms: int = WINDOW_MS, delay: str = "1 minute") -> DataFrame:
    """The same rows over a stream of events (key, seq, ts), which may come late by up to ``delay``.

    Time is that of the events alone, after the start of 1970, so a slow replay gives what a fast one does.  A verdict depends
    on all earlier events of its key; so an event waits until the watermark has passed it, when none
    before it can come any more, and those that wait are judged in order of (at_ms, seq).  A key's state is its
    waiting events and at most ``most`` accepted times; a timer at the first waiting event judges it when no
    further event of the key comes, and one a window after the last accepted time forgets the key.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(events.sparkSession)
    kinds = dict(events.dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, waiting, numbers = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for part in parts:
                waiting += part["at_ms"].tolist()
                numbers += part["seq"].tolist()
        passed = state.getCurrentWatermarkMs()
        queue = sorted(zip(waiting, numbers, strict=True))
        due = [x for x in queue if x[0] <= passed]
        rest, log = queue[len(due) :], SlidingLog(most, window_ms, times)
        verdicts = [log.accept(at) for at, _ in due]
        if not rest and (not log.times or log.times[-1] + window_ms <= passed):
            state.remove()
        else:
            state.update((list(log.times), [at for at, _ in rest], [n for _, n in rest]))
            state.setTimeoutTimestamp(max(passed + 1, rest[0][0] if rest else log.times[-1] + window_ms))
        if due:
            yield pd.DataFrame({"key": key[0], "seq": [n for _, n in due], "at_ms": [at for at, _ in due], "accepted": verdicts})

    rows = events.select("key", "seq", "ts", F.unix_millis("ts").alias("at_ms")).withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(
        run,
        f"key {kinds['key']}, seq {kinds['seq']}, at_ms bigint, accepted boolean",
        f"times array<bigint>, waiting array<bigint>, numbers array<{kinds['seq']}>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def replayed(events: DataFrame, path: str, slices: int = 4, jitter_ms: int = 0) -> DataFrame:
    """Events (key, seq, ts) as a stream of ``slices`` micro-batches in order of time, each event up to ``jitter_ms`` late.

    Two closing batches with an event of a null key move the watermark past all others.
    """
    spark = events.sparkSession
    at = F.unix_millis("ts") + F.pmod(F.xxhash64("key", "seq"), F.lit(max(1, jitter_ms)))
    rows = events.withColumn("_at", at)
    ends = rows.agg(F.min("_at").alias("a"), F.max("_at").alias("b")).first()
    if ends["a"] is None:
        rows.drop("_at").write.parquet(f"{path}/0")
        return spark.readStream.schema(events.schema).parquet(f"{path}/*")
    step = (ends["b"] - ends["a"]) // slices + 1
    for k in range(slices):  # files are read in the order in which they were written
        one = rows.where((F.col("_at") >= ends["a"] + k * step) & (F.col("_at") < ends["a"] + (k + 1) * step)).drop("_at")
        one.coalesce(1).write.parquet(f"{path}/{k}")
    kinds = dict(events.dtypes)
    for k in (1, 2):
        end = spark.range(1).select(F.lit(None).cast(kinds["key"]).alias("key"), F.lit(0).cast(kinds["seq"]).alias("seq"), F.timestamp_millis(F.lit(ends["b"] + k * CLOSING_MS)).alias("ts"))
        end.coalesce(1).write.parquet(f"{path}/{slices + k}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def all_verdicts(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream of verdicts until all that is there has been taken, and read what it wrote; closing events are left out."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").where(F.col("key").isNotNull())


def tail(spark, path: str, to, per_trigger: int = 100) -> DataFrame:
    """An append-only log folder as a stream."""
    return spark.readStream.schema(to).option("maxFilesPerTrigger", per_trigger).parquet(path)


def keep_current(stream: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str):
    """Runs ``rebuild`` on the new rows of each micro-batch, until all that is there has been taken."""
    return (
        stream.writeStream.foreachBatch(lambda df, _: rebuild(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
