"""What a human reviewer sees of a trace, and what becomes of the decision: a labelled trace that is added to a file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.values import text
from tracewright.sources.folders import Folder
from tracewright.sources.traces import TraceLineError, read_lines, trace_lines, validate

DECISIONS = ("verified", "false_success")
_BATCH = "batch="


def _gathered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """trace_id and an array of all other columns, by `order`; a trace's own rows make a row of it, as they do in its file."""
    rest = [order, *(c for c in rows.columns if c not in ("trace_id", order))]
    return rows.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def payload(traces: DataFrame, steps: DataFrame, claims: DataFrame, results: DataFrame, outcomes: DataFrame | None = None, judged: DataFrame | None = None, contributions: DataFrame | None = None) -> DataFrame:
    """trace_id, domain, instruction, final_message, claims, steps, rule_evidence, judge, contributions, verdict and p_success of each trace with a result.

    Labels and meta are in none of it. outcomes: the rules' (trace_id, claim_idx, rule, outcome, step). judged: parsed judgments (a row for each trace); those that
    abstain are left out. contributions: trace_id and an array. Values that hold any JSON are JSON text; what there is nothing of is an empty array, or
    null for the judge.
    """
    shown = steps.select("trace_id", "i", "kind", "role", "name", F.to_json("args").alias("args"), "ok", text(F.col("output")).alias("output"), text(F.col("error")).alias("error"), "content")
    said = claims.select("trace_id", "claim_idx", "type", F.to_json("subject").alias("subject"))
    out = traces.select("trace_id", "domain", "instruction", F.col("final_text").alias("final_message")).join(results.select("trace_id", "verdict", "p_success"), "trace_id")
    parts = {"claims": _gathered(said, "claim_idx", "claims"), "steps": _gathered(shown, "i", "steps")}
    if outcomes is not None:
        parts["rule_evidence"] = _gathered(outcomes.select("trace_id", "claim_idx", "rule", "outcome", "step"), "claim_idx", "rule_evidence")
    if judged is not None:
        fields = ("p", "failure_kind", "rationale", "evidence_steps", "invalid_citation")
        parts["judge"] = judged.where("NOT abstain").select("trace_id", F.struct(*fields).alias("judge"))
    if contributions is not None:
        parts["contributions"] = contributions.select("trace_id", "contributions")
    for name, part in parts.items():
        out = out.join(part, "trace_id", "left")
        if name != "judge":
            out = out.withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def reviewed_lines(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """trace_id and value, the line of each decided trace of (trace_id, v) with the decision as its label, whatever label it had.

    decisions: trace_id, decision (verified or false_success), note, previous_verdict and reviewed_at, one for each trace. Others than these two decisions are an error.
    """
    bad = F.raise_error(F.concat(F.lit("no such decision: "), F.coalesce("decision", F.lit("null"))))
    outcome = F.when(F.col("decision") == "verified", "success").when(F.col("decision") == "false_success", "failure").otherwise(bad)
    details = F.struct("decision", "note", "previous_verdict", "reviewed_at")
    truth = F.to_json(F.struct(F.lit("human").alias("checked_by"), details.alias("details"), outcome.alias("outcome")), {"ignoreNullFields": "false"})
    decided = decisions.select("trace_id", truth.alias("truth"))
    return trace_lines(lines.join(decided, "trace_id"), {"ground_truth": F.col("truth")})


def append_reviews(lines: DataFrame, decisions: DataFrame, path: str, batch: int) -> bool:
    """Add a batch of reviewed traces to the folder; False if the batch is there already. Lines are checked before the batch gets its name."""
    spark, folder, aside = lines.sparkSession, Folder(lines.sparkSession, path), f"_aside-{uuid.uuid4().hex}"
    name = f"{_BATCH}{batch:020d}"
    if folder.exists(name):
        return False
    try:
        reviewed_lines(lines, decisions).select("value").write.text(folder.at(aside))
        first = validate(read_lines(spark, folder.at(aside))).errors.orderBy("file", "line_no", "json_path", "message").first()
        if first:
            raise TraceLineError(f"{first.json_path}: {first.message}")
        return folder.rename_new(aside, name)
    finally:
        folder.delete(aside)
