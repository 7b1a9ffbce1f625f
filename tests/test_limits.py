"""Rate limits: the stream equals the batch, and all keys are forgotten beyond a number of them."""

import random

import pytest
from pyspark.sql import functions as F

EVENTS = "key string, seq int, at_ms long"


def events_of(rng, n, keys, span):
    return [(f"k{rng.randrange(keys)}", i, rng.randrange(span)) for i in range(n)]


def plain(events, most, window, most_keys=None):
    """One server's own loop: accepted by seq, and the epoch of each."""
    times, out, epoch = {}, {}, 0
    for key, seq, at in sorted(events, key=lambda e: (e[2], e[1], e[0])):
        if most_keys is not None and len(times) > most_keys:
            times.clear()
            epoch += 1
        recent = [t for t in times.get(key, []) if at - t < window]
        ok = len(recent) < most
        times[key] = [*recent, at] if ok else recent
        out[seq] = (ok, epoch)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_epochs(spark, seed):
    from vitagraph.streaming import limits

    events = events_of(random.Random(seed), 300, 25, 400)
    df = spark.createDataFrame(events, EVENTS)
    want = plain(events, 2, 60, 9)
    assert {r["seq"]: r["epoch"] for r in limits.epochs(df, 9).collect()} == {s: e for s, (_, e) in want.items()}
    assert {r["seq"]: r["accepted"] for r in limits.limited_in_epochs(df, 2, 60, 9).collect()} == {s: a for s, (a, _) in want.items()}
    assert {r["epoch"] for r in limits.epochs(df, 25).collect()} == {0}
    assert limits.epochs(df.limit(0), 3).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Shuffled micro-batches, events late by up to the delay, ties of time, keys that come back after their state went."""
    from vitagraph.streaming import limits

    rng = random.Random(5)
    rows = [(k, i, 1_000_000 + at * 1000) for k, i, at in events_of(rng, 400, 6, 600)] + [("gone", 1000, 1_001_000), ("gone", 1001, 1_001_000), ("gone", 1002, 1_590_000)]
    df = spark.createDataFrame(rows, EVENTS)
    events = df.select("key", "seq", F.timestamp_millis("at_ms").alias("ts"))
    stream = limits.replayed(events, f"file://{tmp_path}/replay", slices=5, jitter_ms=20_000)
    got = limits.all_verdicts(limits.limited_stream(stream, 3, 40_000, "30 seconds"), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, limits.limited(df, 3, 40_000).collect()))
    assert {r["seq"]: r["accepted"] for r in got.collect()} == {s: a for s, (a, _) in plain(rows, 3, 40_000).items()}
