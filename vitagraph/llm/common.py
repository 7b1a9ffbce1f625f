"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, materialize, scoped, ship

__all__ = ["WORD", "Forest", "arrow_map", "discard", "materialize", "n_words", "read", "scoped", "segments", "ship", "tidied", "whole_groups"]

#: A word is a run of characters other than space and U+0009 to U+000D.  On UTF-8 bytes
#: ``bytes.split()`` splits at exactly these six, so Python code splits encoded texts.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts turned into Python objects at a time; bounds a worker's memory.
SLICE = 128


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidied(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches; at the end of a task its worker, which lives on, gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps its own counsel
                pass

    return run


def arrow_map(
    df: DataFrame, inputs: list[Column], schema: str, make: Callable[[], Callable[[list[list]], list[list]]]
) -> DataFrame:
    """Map slices of rows in Python through Arrow.

    ``inputs`` are the aliased columns handed over; ``make()`` runs once for each task and
    returns a function from their values (a list for each input) to lists of output values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = step([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(made, out, strict=True)], schema=out
                )

    ship(df.sparkSession)
    return df.select(*inputs).mapInArrow(tidied(run), schema)


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups from batches sorted by numeric keys, with the place where each group starts.

    A group is held until its last row has come, however many batches it spans.
    """
    import numpy as np

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(table)
            continue
        # all up to the last change is complete
        end, before = int(cuts[-1]), sum(t.num_rows for t in held)
        yield pa.concat_tables([*held, table.slice(0, end)]), [0] * bool(before or cuts[0]) + [before + int(c) for c in cuts[:-1]]
        held = [table.slice(end)]
    if held:
        yield pa.concat_tables(held), [0]


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each group of batches sorted by numeric keys."""
    for table, starts in whole_groups(batches, keys):
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            yield table.slice(a, b - a)


class Forest:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True
