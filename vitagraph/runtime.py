"""What a session needs: this package on the executors, and a shared folder for written stages."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        made = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(made, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(made))
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session whose executors are threads of the driver gets a folder of its
    own; on a cluster there is no folder to guess, and it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp()}")
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class _Scopes(threading.local):
    """Written tables of the scopes that are open in this thread, innermost last."""

    def __init__(self):
        self.open: list[list[DataFrame | Folder]] = []


_scopes = _Scopes()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never a recomputation of
    what came before, and no result depends on how often a stage was retried.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    for scope in _scopes.open[-1:]:
        scope.append(out)
    return out


class Folder:
    """A folder in the shared one; a scope deletes it like a written table."""

    def __init__(self, spark: SparkSession, written: str):
        self.sparkSession, self.written = spark, written


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the innermost open scope deletes."""
    folder = Folder(spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    for scope in _scopes.open[-1:]:
        scope.append(folder)
    return folder.written


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    if not exists(spark, path):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().getName() for f in found)


def state_of(spark: SparkSession, *paths: str) -> str:
    """What tells one state of files or folders from another: names, sizes and times of what lies there."""
    context, found = spark.sparkContext, []
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(at)
        found += [f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files]
    return "\n".join(sorted(found))


def remover(spark: SparkSession, path: str) -> Callable[[], None]:
    """A function that deletes a folder, also after the session has been stopped."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda: store.delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of all past jobs, those of the last one too, to which a first collection leaves references."""
    gc.collect()
    for pause in (0.3, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def discard(*tables: DataFrame | Folder) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of past jobs.

    Spark drops these once the JVM's garbage collector has seen that no plan refers to them.
    """
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        for scope in _scopes.open:
            scope[:] = [t for t in scope if t is not table]
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def scoped(label: str) -> Callable:
    """For a function that returns a table: its result is written, and all that it wrote before is deleted."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(*args, **kwargs) -> DataFrame:
            _scopes.open.append([])
            try:
                made = f(*args, **kwargs)
                # the result belongs to the scope outside, if there is one
                inner = _scopes.open.pop()
            except BaseException:
                discard(*_scopes.open.pop())
                raise
            out = materialize(made, label)
            del made
            discard(*inner)
            return out

        return run

    return wrap


@contextlib.contextmanager
def keeping() -> Iterator[list[DataFrame]]:
    """A scope whose written tables are deleted at its end, but those put into the list, which belong to the scope outside."""
    kept: list[DataFrame] = []
    _scopes.open.append([])
    try:
        yield kept
    finally:
        inner = _scopes.open.pop()
        discard(*[t for t in inner if not any(t is k for k in kept)])
        for scope in _scopes.open[-1:]:
            scope.extend(t for t in inner if any(t is k for k in kept))


def in_order(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3, ... in the order given, which should leave no ties.

    Range partitions are numbered by the counts of those before them, so no task sees all rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "in-order")
    sizes = dealt.groupBy("_p").count()  # a row for each partition
    before = sizes.select(F.col("_p").alias("_q"), (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_base"))
    local = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return local.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, F.col("_base") + F.col("_i")).drop("_p", "_q", "_i", "_base")
