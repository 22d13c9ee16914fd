"""Folders that the driver and all executors share, and steps on them that happen whole or not at all."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where all tasks run in the driver's process may it be unset: then a temporary folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tracewright-')}")
        found = context.getCheckpointDir()
    return found


#: Scratch paths that go when the driver ends.
_MADE: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/tracewright/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            Folder(spark, path).delete()
        except Exception:  # the session has ended already; the folder's owner clears it
            return


def pinned(df: DataFrame, name: str, together: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: what Spark would decide anew on a second run, like sampled ranges, is fixed.

    together: of large rows, how many a task holds at once when it writes or reads them. Else these are all rows of a row group, up to thousands.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("parquet.block.row.count.limit", together) if together else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._of(self.at(name) if name else self.path))

    def names(self, prefix: str = "") -> list[str]:
        """Names of the files and folders in this one, sorted."""
        if not self.exists():
            return []
        found = [x.getPath().getName() for x in self._fs.listStatus(self._of(self.path))]
        return sorted(n for n in found if n.startswith(prefix))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._of(self.at(name) if name else self.path), True)

    def rename_new(self, source: str, target: str) -> bool:
        """Rename source, unless there is a target already. Both are names in this folder.

        A store's rename of a folder onto a folder moves it inside: so the target is looked up before, and a move inside is undone.
        """
        if self.exists(target):
            return False
        self._fs.mkdirs(self._of(self.path))
        moved = self._fs.rename(self._of(self.at(source)), self._of(self.at(target)))
        inner = f"{target}/{source.rpartition('/')[2]}"
        if moved and self.exists(inner):
            self.delete(inner)
            return False
        return moved

    def put_text(self, name: str, text: str) -> bool:
        """A small file, unless there is one of this name: written aside and renamed."""
        aside = f"_put-{uuid.uuid4().hex}"
        out = self._fs.create(self._of(self.at(aside)), True)
        out.write(bytearray(text.encode()))
        out.close()
        done = self.rename_new(aside, name)
        if not done:
            self.delete(aside)
        return done

    def get_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        rows = self.spark.read.text(self.at(name), wholetext=True).head(1)
        return rows[0].value if rows else ""

