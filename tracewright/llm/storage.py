"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tracewright.sources.folders import shared_folder

#: Tables (session, path, catalog name or None) that go when the driver ends.
_WRITTEN: list[tuple[SparkSession, str, str | None]] = []
_OPEN = threading.local()
#: Spark then drops the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop(tables: list[tuple[SparkSession, str, str | None]]) -> None:
    for spark, path, name in tables:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


def _scopes() -> list[list[tuple[SparkSession, str, str | None]]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = [_WRITTEN]
    return _OPEN.scopes


class scratch:
    """Tables written inside the block go when it ends, but for those that `out` writes."""

    def __enter__(self) -> scratch:
        self.mine: list[tuple[SparkSession, str, str | None]] = []
        _scopes().append(self.mine)
        return self

    def out(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that outlives the block."""
        scopes = _scopes()
        inner = scopes.pop()
        try:
            return written(df, name)
        finally:
            scopes.append(inner)

    def __exit__(self, *_: object) -> None:
        _scopes().pop()
        _drop(self.mine)


#: Tables that stages of a pipeline have left behind.
_LEFT: list[tuple[SparkSession, str, str | None]] = []


@contextlib.contextmanager
def staged() -> Iterator[None]:
    """Tables written inside the block are left to `release`: the block's result reads them, so they stay for now."""
    mine: list[tuple[SparkSession, str, str | None]] = []
    _scopes().append(mine)
    try:
        yield
    finally:
        _scopes().pop()
        _LEFT.extend(mine)


def release(docs: DataFrame) -> None:
    """Drop what earlier stages have left, but for tables that docs reads: the next stage begins when docs, their result, is written."""
    if not _LEFT:
        return
    read = docs.inputFiles()
    if not read:  # rows from elsewhere: who knows what is still to be read
        return
    still = [t for t in _LEFT if any(t[1].rpartition("/")[2] in f for f in read)]
    gone = [t for t in _LEFT if t not in still]
    _LEFT[:] = still
    _drop(gone)


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, name: str, together: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage and outlives lost executors.

    The shuffle files of making it go at once, the table with its `scratch` block or else when the driver ends.
    together: of large rows, how many a task holds at once when it writes or reads them. Else these are all rows of a row group, up to thousands.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracewright/{name}-{uuid.uuid4().hex}"
    _scopes()[-1].append((spark, path, None))
    with _dropping_shuffles(spark):
        (df.write.option("parquet.block.row.count.limit", together) if together else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table of the shared folder, bucketed by key like the shuffles of the session: joins on the key don't move it again."""
    spark = df.sparkSession
    table = f"tracewright_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tracewright/{table}"
    _scopes()[-1].append((spark, path, table))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _dropping_shuffles(spark):
        df.write.bucketBy(n, key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


@atexit.register
def _clean() -> None:
    for table in [*_WRITTEN, *_LEFT]:
        try:
            _drop([table])
        except Exception:  # the session has ended already; the folder's owner clears it
            return
