"""Answers of a judge as a table that is addressed by content and only grows.

A row is kept under the digest of model, prompt version and request, with a digest of its own. New rows come in segments: rows whose key is
there already are left out, the segment is written aside and renamed to the next number, and a writer that finds the number taken looks
again at what is new. So a key has one valid row, the first. A row that doesn't match its digest, or holds no content, is
a miss: it is asked for again. Compaction writes what is valid into a snapshot; readers take the last snapshot and the segments
after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.folders import Folder

ROW = "cache_key string, content string, usage string, check string"
_SEGMENT, _SNAPSHOT = "segment=", "snapshot="


def cache_key(model: Column, version: Column, request: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, version.cast("string"), request), 256)


def _check() -> Column:
    return F.sha2(F.concat_ws("\n", "cache_key", F.char_length("content").cast("string"), "content", "usage"), 256)


class JudgeCache:
    """The cache in a folder. A folder that isn't there is an empty cache."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def _parts(self) -> tuple[list[str], int]:
        """The folders that hold the cache now, and the next segment's number."""
        segments, snapshots = self.folder.names(_SEGMENT), self.folder.names(_SNAPSHOT)
        number = lambda n: int(n.partition("=")[2])
        upto = number(snapshots[-1]) if snapshots else -1
        last = max([upto, *map(number, segments)])
        return [*snapshots[-1:], *(s for s in segments if number(s) > upto)], last + 1

    def rows(self) -> DataFrame:
        """All rows, valid or not."""
        parts, _ = self._parts()
        if not parts:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*map(self.folder.at, parts))

    def read(self) -> DataFrame:
        """cache_key, content and usage (a JSON object) of the valid rows."""
        good = self.rows().where(F.col("content").isNotNull() & (F.col("check") == _check()))
        usage = F.when(F.schema_of_variant(F.try_parse_json("usage")).startswith("OBJECT"), F.col("usage")).otherwise("{}")
        return good.select("cache_key", "content", usage.alias("usage"))

    def merge(self, new: DataFrame, attempts: int = 10) -> int:
        """Add the answers (cache_key, content[, usage]) whose key has no valid row; of several for one key, the least. How many were added."""
        usage = F.coalesce(F.col("usage"), F.lit("{}")) if "usage" in new.columns else F.lit("{}")
        each = new.where("cache_key IS NOT NULL AND content IS NOT NULL").select("cache_key", "content", usage.alias("usage"))
        each = each.groupBy("cache_key").agg(F.min(F.struct("content", "usage")).alias("a")).select("cache_key", "a.content", "a.usage")
        for _ in range(attempts):
            _, number = self._parts()
            aside = f"_aside-{uuid.uuid4().hex}"
            try:
                each.join(self.read().select("cache_key"), "cache_key", "left_anti").select("*", _check().alias("check")).write.parquet(self.folder.at(aside))
                added = self.spark.read.schema(ROW).parquet(self.folder.at(aside)).count()
                if not added or self.folder.rename_new(aside, f"{_SEGMENT}{number:012d}"):
                    return added
            finally:
                self.folder.delete(aside)
        raise RuntimeError(f"other writers took each of {attempts} segment numbers")

    def compact(self) -> None:
        """One snapshot of all valid rows. Segments that it covers go; readers that began before keep their list of files until they end, so compact between runs."""
        parts, number = self._parts()
        if not parts:
            return
        aside = f"_aside-{uuid.uuid4().hex}"
        self.read().select("*", _check().alias("check")).write.parquet(self.folder.at(aside))
        if not self.folder.rename_new(aside, f"{_SNAPSHOT}{number - 1:012d}"):
            self.folder.delete(aside)
            return
        for old in parts:
            self.folder.delete(old)
