"""Checks of a labelled dataset, each a query whose rows are the findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.metrics import auroc
from tracewright.operators.report import contained


def cell_differences(traces: DataFrame, design: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells whose count isn't the design's (keys, n), missing and surplus ones included."""
    found = traces.groupBy(*keys).agg(F.count("*").alias("found"))
    joined = design.select(*keys, F.col("n").alias("wanted")).join(found, list(keys), "full_outer").fillna(0, ["wanted", "found"])
    return joined.where("wanted != found")


def shares(traces: DataFrame) -> DataFrame:
    """By split and domain: the share of successes."""
    return traces.groupBy("split", "domain").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("success_share"))


def sizes(traces: DataFrame, train: int, test: int, genuine_test: int, domains: DataFrame) -> DataFrame:
    """domain, finding, wanted and found where a domain of `domains` hasn't so many train, test, genuine test and false test traces."""
    test_row = F.col("split") == "test"
    counts = traces.groupBy("domain").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(test_row).alias("test"), F.count_if(test_row & (F.col("label") == 1)).alias("genuine_test"), F.count_if(test_row & (F.col("label") == 0)).alias("false_test")
    )
    wanted = {"train": train, "test": test, "genuine_test": genuine_test, "false_test": test - genuine_test}
    each = domains.select("domain").distinct().join(counts, "domain", "left").fillna(0, list(wanted))
    rows = each.select("domain", F.explode(F.array(*(F.struct(F.lit(k).alias("finding"), F.lit(n).cast("long").alias("wanted"), F.col(k).alias("found")) for k, n in wanted.items()))).alias("x"))
    return rows.select("domain", "x.finding", "x.wanted", "x.found").where("wanted != found")


def rare_kinds(traces: DataFrame, kinds: DataFrame, domains: DataFrame, least: int = 2) -> DataFrame:
    """domain, kind and found of the false kinds (kind) with fewer than `least` test traces in a domain; both lists are of the design, a row for each kind and domain."""
    counts = traces.where("split = 'test' AND label = 0").groupBy("domain", "kind").agg(F.count("*").alias("found"))
    design = domains.select("domain").distinct().withColumn("kind", F.explode(F.array(*(F.lit(r.kind) for r in kinds.select("kind").distinct().orderBy("kind").collect()))))
    return design.join(counts, ["domain", "kind"], "left").fillna(0, ["found"]).where(F.col("found") < least)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of the files at a path, read whole: files of a benchmark, of 2 GB at most. Empty files, which Spark passes over, have no row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest_differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, wanted and found where a digest (name, sha256) isn't that of the manifest (name, sha256), files that only one of them has included."""
    joined = manifest.select("name", F.col("sha256").alias("wanted")).join(found.select("name", F.col("sha256").alias("found")), "name", "full_outer")
    return joined.where(~F.col("wanted").eqNullSafe(F.col("found")))


def without_claim(traces: DataFrame, success: DataFrame) -> DataFrame:
    return traces.join(success.select("trace_id").distinct(), "trace_id", "left_anti")


def split_leaks(entities: DataFrame, blobs: DataFrame) -> DataFrame:
    """(entity, trace_id) where an entity (entity, split) of one split only is part of a trace's text (trace_id, split, blob) of the other."""
    one = entities.groupBy("entity").agg(F.min("split").alias("split"), F.count_distinct("split").alias("n")).where("n = 1")
    passages = one.select(F.col("entity").alias("passage_id"), F.col("entity").alias("passage"), F.col("split").alias("side"))
    met = contained(passages, blobs.select(F.col("trace_id").alias("text_id"), F.col("blob").alias("body"), F.col("split").alias("side")), apart=True)
    return met.select(F.col("passage_id").alias("entity"), F.col("text_id").alias("trace_id"))


def step_count_auroc(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """How well the mere number of steps tells the label."""
    n = steps.groupBy("trace_id").agg(F.count("*").cast("double").alias("score"))
    return auroc(n.join(labels, "trace_id"))
