"""Recorded runs: a folder of JSON-lines files with what an evaluation saw, read back as tables, and checked against what it would ask now.

Each file is a folder of parts that tasks write side by side, moved to its name as a whole; a file that isn't there is an empty table. Any
store that Spark reads will do. Numbers are as recorded: reading fits and times nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.folders import Folder

PREDICTIONS = (
    "detector string, trace_id string, split string, domain string, outcome string, injection string, evidence string, variant string, p_raw double, p_cal double, "
    "abstain boolean, abstain_reason string, rule_outcome string"
)
TIMINGS = "detector string, trace_id string, latency_ms double"
JUDGE_RECORDS = (
    "detector string, trace_id string, split string, model string, prompt_name string, prompt_sha256 string, request_sha256 string, p_raw double, p_cal double, abstain boolean, abstain_reason string, "
    "failure_kind string, latency_ms double, cost_usd double, cached boolean"
)
#: Files by name and the columns of their lines.
FILES = {"offline-predictions.jsonl": PREDICTIONS, "offline-timings.jsonl": TIMINGS, "judge-records.jsonl": JUDGE_RECORDS}
RUN, CALIBRATION = "run.json", "calibration.json"


def json_lines(df: DataFrame) -> DataFrame:
    """value: a compact JSON object for each row, with sorted keys, and nulls written out."""
    return df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("value"))


@dataclass(frozen=True)
class RecordedRun:
    """meta and calibration are small objects of run.json and calibration.json; the rest are tables."""

    meta: dict
    calibration: dict
    predictions: DataFrame
    timings: DataFrame
    judge_records: DataFrame


class RunFolder:
    """A recorded run's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def write(self, name: str, df: DataFrame) -> None:
        """One of FILES, which isn't there yet; columns that df lacks are null, others of it are left out."""
        if self.folder.exists(name):
            raise FileExistsError(f"{name} is recorded already")
        kinds = dict(c.rsplit(" ", 1) for c in FILES[name].split(", "))
        cells = df.select(*((F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()))
        aside = f"_aside-{uuid.uuid4().hex}"
        try:
            json_lines(cells).write.text(self.folder.at(aside))
            if not self.folder.rename_new(aside, name):
                raise FileExistsError(f"{name} is recorded already")
        finally:
            self.folder.delete(aside)

    def write_object(self, name: str, found: dict) -> None:
        """run.json or calibration.json, indented and with sorted keys."""
        if not self.folder.put_text(name, json.dumps(found, indent=2, sort_keys=True, ensure_ascii=False) + "\n"):
            raise FileExistsError(f"{name} is recorded already")

    def _object(self, name: str) -> dict:
        return json.loads(self.folder.get_text(name) or "{}")

    def table(self, name: str) -> DataFrame:
        """A file's lines in full; a line that is no JSON object fails the read, as a record that was cut is no record."""
        if not self.folder.exists(name):
            return self.spark.createDataFrame([], FILES[name])
        return self.spark.read.schema(FILES[name]).option("mode", "FAILFAST").json(self.folder.at(name))

    def read(self) -> RecordedRun:
        return RecordedRun(self._object(RUN), self._object(CALIBRATION), *map(self.table, FILES))


def tampered(records: DataFrame, prompts: DataFrame, traces: DataFrame, specs: DataFrame, request: Column) -> DataFrame:
    """trace_id, detector, reason, recorded and found of the records that are not what would be asked now.

    records: as in judge-records.jsonl. prompts: prompt_name, prompt (its text). traces: trace_id, split and what a request is rendered from. specs: model and
    what of it is in a request. request: the request's text over the columns of all four. The first of these that holds is the
    reason: prompt_sha256 (a prompt that is gone, or another text), unknown_trace, no_spec, request_sha256. A null digest matches nothing. Records come as often
    as they were recorded; prompts, traces (by trace_id and split) and specs are taken to be unique.
    """
    digest = prompts.select("prompt_name", "prompt", F.sha2("prompt", 256).alias("_prompt_sha"))
    known = traces.withColumn("_known", F.lit(True)).withColumnRenamed("trace_id", "_trace").withColumnRenamed("split", "_split")
    spec = specs.withColumn("_spec", F.lit(True)).withColumnRenamed("model", "_model")
    own = records.select("trace_id", "split", "detector", "model", "prompt_name", "prompt_sha256", "request_sha256")
    joined = own.join(digest, "prompt_name", "left").join(known, (F.col("trace_id") == F.col("_trace")) & F.col("split").eqNullSafe(F.col("_split")), "left").join(spec, F.col("model") == F.col("_model"), "left")
    same = lambda a, b: F.coalesce(F.col(a) == b, F.lit(False))
    asked = F.sha2(request, 256)
    reason = (
        F.when(~same("prompt_sha256", F.col("_prompt_sha")), "prompt_sha256").when(F.col("_known").isNull(), "unknown_trace").when(F.col("_spec").isNull(), "no_spec").when(~same("request_sha256", asked), "request_sha256")
    )
    found = joined.withColumn("reason", reason).where("reason IS NOT NULL")
    pick = lambda a, b: F.when(F.col("reason") == "prompt_sha256", a).when(F.col("reason") == "request_sha256", b)
    return found.select("trace_id", "detector", "reason", pick(F.col("prompt_sha256"), F.col("request_sha256")).alias("recorded"), pick(F.col("_prompt_sha"), asked).alias("found"))
