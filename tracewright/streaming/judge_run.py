"""A run of a judge over a queue of traces: in chunks, with progress that is there whole after each one, to be cancelled and taken up again.

The queue is cut into chunks by exact ranks, so chunks have one size whatever the ids. A chunk's results are written aside and renamed to
its number; what is done is what has a number. After a crash the next run of the same folder goes on with the first chunk that is
missing, and asks for nothing twice. A cancelled run finishes the chunk in hand.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.ranks import ranked
from tracewright.sources.folders import Folder

RESULT = {"trace_id": "string", "verdict": "string", "p_success": "double", "cost_usd": "double", "error": "string"}
_CHUNK = "chunk="


class AlreadyRunning(Exception):
    """There is a run in the folder that was neither finished nor cancelled."""


class JudgeRun:
    """score takes a DataFrame of trace_id and returns RESULT's columns, a row for each; a row's own failure is in its error."""

    def __init__(self, spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.score = spark, Folder(spark, path), score

    def start(self, queue: DataFrame, chunk: int = 1000) -> dict:
        """Lay down the queue, its distinct trace ids in order. A folder holds one run."""
        begun = self.folder.get_text("run.json")
        if begun:
            raise AlreadyRunning(json.loads(begun)["run_id"])
        ids = ranked(queue.select("trace_id").where("trace_id IS NOT NULL").distinct(), [F.col("trace_id")])
        aside = f"_queue-{uuid.uuid4().hex}"
        ids.select("trace_id", F.floor(F.col("rank") / chunk).cast("int").alias("chunk")).write.partitionBy("chunk").parquet(self.folder.at(aside))
        total = self.spark.read.schema("trace_id string, chunk int").parquet(self.folder.at(aside)).count()
        run_id = uuid.uuid4().hex
        # The marker goes first: of two that start at once, one has it.
        if not self.folder.put_text("run.json", json.dumps({"run_id": run_id, "total": total, "chunks": -(-total // chunk), "queue": aside})):
            self.folder.delete(aside)
            raise AlreadyRunning(json.loads(self.folder.get_text("run.json"))["run_id"])
        return self.snapshot()

    def _run(self) -> dict:
        found = self.folder.get_text("run.json")
        if not found:
            raise LookupError("no run was started here")
        return json.loads(found)

    def cancel(self) -> None:
        """No chunk begins after this."""
        self.folder.put_text("cancelled", "")

    def _write(self, df: DataFrame, number: int) -> None:
        aside = f"_aside-{uuid.uuid4().hex}"
        try:
            df.select(*(F.col(c).cast(k).alias(c) for c, k in RESULT.items())).write.parquet(self.folder.at(aside))
            self.folder.rename_new(aside, f"{_CHUNK}{number:012d}")
        finally:
            self.folder.delete(aside)

    def go(self, chunks: int | None = None) -> dict:
        """Score what is left, or so many chunks of it. A chunk whose job fails is recorded with error worker_error for each of its traces, and the others go on."""
        run = self._run()
        done = set(self.folder.names(_CHUNK))
        for number in range(run["chunks"]):
            if f"{_CHUNK}{number:012d}" in done:
                continue
            if self.folder.exists("cancelled") or chunks == 0:
                break
            ids = self.spark.read.parquet(self.folder.at(f"{run['queue']}/chunk={number}")).select("trace_id")
            try:
                self._write(self.score(ids), number)
            except Exception:
                lost = {"verdict": None, "p_success": None, "cost_usd": 0.0, "error": "worker_error"}
                self._write(ids.select("trace_id", *(F.lit(v).cast(RESULT[c]).alias(c) for c, v in lost.items())), number)
            chunks = None if chunks is None else chunks - 1
        return self.snapshot()

    def results(self) -> DataFrame:
        """The rows of all chunks that are done."""
        done = self.folder.names(_CHUNK)
        schema = ", ".join(f"{c} {k}" for c, k in RESULT.items())
        return self.spark.read.schema(schema).parquet(*map(self.folder.at, done)) if done else self.spark.createDataFrame([], schema)

    def snapshot(self) -> dict:
        """run_id, status (running, cancelled or completed), total, done, errors and spent_usd."""
        run = self._run()
        row = self.results().agg(F.count("*").alias("done"), F.count("error").alias("errors"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent")).first()
        status = "completed" if row.done >= run["total"] else "cancelled" if self.folder.exists("cancelled") else "running"
        return {"run_id": run["run_id"], "status": status, "total": run["total"], "done": row.done, "errors": row.errors, "spent_usd": round(row.spent, 6)}
