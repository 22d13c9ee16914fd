"""Auditing traces as they arrive: the same expressions on a stream of JSON lines."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.functions.scores import Thresholds, gate
from tracewright.operators.claims import extract_claims, resolve_claims, success_claims
from tracewright.operators.detectors import results, rules
from tracewright.sources.folders import Folder, pinned
from tracewright.sources.packs import RulePack
from tracewright.sources.traces import line_errors, validate


def trace_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Valid traces (trace_id, v, at) of JSON-lines files that appear in a folder; later copies of an id within the delay are dropped."""
    lines = spark.readStream.text(folder).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    valid = lines.where("v IS NOT NULL").where(F.size(line_errors(F.col("v"))) == 0)
    named = valid.select(F.try_variant_get("v", "$.trace_id", "string").alias("trace_id"), "v", F.current_timestamp().alias("at"))
    return named.withWatermark("at", delay).dropDuplicatesWithinWatermark(["trace_id"])


def error_verdicts(traces: DataFrame) -> DataFrame:
    """The any-error detector and the gate, row by row: a trace is one row of the stream."""
    steps = F.try_variant_get("v", "$.steps", "array<variant>")
    get = lambda s, k, as_: F.try_variant_get(s, f"$.{k}", as_)
    bad = F.exists(steps, lambda s: (get(s, "kind", "string") == "tool_result") & (F.coalesce(~get(s, "ok", "boolean"), F.lit(False)) | F.coalesce(~F.to_json(get(s, "error", "variant")).isin("null", '""', "{}"), F.lit(False))))
    p = F.when(bad, 0.0).otherwise(1.0)
    return traces.select("trace_id", "at", p.alias("p"), gate(p, F.lit(False)).alias("verdict"))


def verdict_counts(verdicts: DataFrame, window: str = "5 minutes") -> DataFrame:
    return verdicts.groupBy(F.window("at", window).alias("w"), "verdict").agg(F.count("*").alias("n")).select("w.start", "verdict", "n")


def write_results(verdicts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def audit_stream(spark: SparkSession, source: str, target: str, state: str, packs: Sequence[RulePack], thresholds: Thresholds = Thresholds()) -> StreamingQuery:
    """Check files of traces as they appear in a folder, with the rules: results and errors of each batch, in target/results and target/errors.

    A line that is no valid trace has a row for each of its errors, with its file; the line's number is that in its batch's part of the file. Ids are unique within a
    batch. Each batch is written aside and renamed to its number, results after errors, so a batch that is sent again adds nothing.
    """
    lines = spark.readStream.text(source).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def audit(df: DataFrame, number: int) -> None:
        numbered = pinned(df.withColumn("at", F.monotonically_increasing_id()), "lines")
        first = numbered.groupBy("file", "block").agg(F.min("at").alias("first"))
        loaded = validate(numbered.join(first, ["file", "block"]).select("file", (F.col("at") - F.col("first") + 1).alias("line_no"), "value"))
        traces, steps = loaded.traces(), loaded.steps()
        success = success_claims(resolve_claims(loaded.claims(), extract_claims(traces, steps, packs)))
        out = results(traces, rules(traces, steps, success, packs), success, thresholds)
        for name, part in (("errors", loaded.errors), ("results", out)):
            folder, aside = Folder(spark, f"{target}/{name}"), f"_aside-{uuid.uuid4().hex}"
            try:
                if not folder.exists(f"batch={number:020d}"):
                    part.write.parquet(folder.at(aside))
                    folder.rename_new(aside, f"batch={number:020d}")
            finally:
                folder.delete(aside)

    return lines.writeStream.option("checkpointLocation", state).foreachBatch(audit).trigger(availableNow=True).start()
