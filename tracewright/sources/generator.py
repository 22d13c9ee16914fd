"""Labelled traces of any number, made by Spark from the row number alone: genuine ones and six kinds of false success.

Each trace is one row of arrays that is built by column expressions on hashes of (seed, id), so any number of executors can
make any number of traces, and equal seeds give equal traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GENUINE = ("clean", "recovered", "noisy")
FALSE = ("phantom_action", "error_ignored", "wrong_target", "wrong_value", "not_persisted", "partial_completion")
STEP = "struct<kind: string, role: string, name: string, content: string, args: string, ok: boolean, output: string, error: string>"
_TOOLS = {"booking": ("calendar.search_slots", "calendar.create_event", "calendar.get_event"), "crm": ("crm.get_contact", "crm.update_contact", "crm.read_record"), "coding": ("fs.read_file", "fs.write_file", "ci.run_tests")}


def _step(kind: str, role: str, name: Column | None = None, content: Column | None = None, args: Column | None = None, ok: bool | None = None, output: Column | None = None, error: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = {"kind": F.lit(kind), "role": F.lit(role), "name": name, "content": content, "args": args, "ok": F.lit(ok).cast("boolean"), "output": output, "error": F.lit(error)}
    return F.struct(*((none if c is None else c).alias(k) for k, c in parts.items())).cast(STEP)


def generate(spark: SparkSession, n: int = 0, seed: int = 0, partitions: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """n traces, or one for each row of ids (id): trace_id, domain, split, kind, evidence, label (1: success), instruction, final_text, claim_type, subject (JSON) and steps.

    Three in five are genuine; two in three of all were probed; a third are in the test split. Every id has the same form, so it
    tells nothing of the label.
    """
    draw = lambda name, size: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(size))
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), (k + 1).cast("int"))
    rows = ids.select(F.col("id").cast("long").alias("id")) if ids is not None else spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rows = rows.withColumn("domain", pick(list(_TOOLS), draw("domain", 3))).withColumn("label", (draw("label", 5) < 3).cast("int"))
    rows = rows.withColumn("kind", F.when(F.col("label") == 1, pick(GENUINE, draw("kind", 3))).otherwise(pick(FALSE, draw("kind", 6))))
    rows = rows.withColumn("evidence", F.when(draw("probe", 3) < 2, "state_probe").otherwise("receipt_only")).withColumn("split", F.when(draw("split", 3) < 2, "train").otherwise("test"))
    rows = rows.withColumn("target", F.format_string("rec_%05d", draw("target", 100_000))).withColumn("other", F.format_string("rec_%05d", F.pmod(draw("target", 100_000) + 1, F.lit(100_000)))).withColumn("value", draw("value", 900) + 100)
    kind, json = F.col("kind"), lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())))
    tool = lambda k: F.element_at(F.create_map(*(F.lit(x) for d, t in _TOOLS.items() for x in (d, t[k]))), F.col("domain"))
    record = F.when(kind == "wrong_target", F.col("other")).otherwise(F.col("target"))
    value = F.when(kind == "wrong_value", F.col("value") + 1).otherwise(F.col("value"))
    state = F.when(kind.isin("phantom_action", "error_ignored", "not_persisted", "wrong_target"), F.lit(0)).when(kind == "wrong_value", F.col("value") + 1).otherwise(F.col("value"))
    one = {"booking": ("booked", "duration_min"), "crm": ("updated", "value"), "coding": ("fixed", "value")}
    args = json(record_id=record, path=record, start=F.lit("2026-03-02T09:00:00Z"), duration_min=value, value=value)
    guest = lambda r: F.concat(r, F.lit("@example.test"))
    receipt = json(attendees=F.array(guest(record)), record_id=record, path=record, event_id=record, start=F.lit("2026-03-02T09:00:00Z"), status=F.when(kind == "not_persisted", "accepted").otherwise("confirmed"), value=value)
    read = [_step("tool_call", "agent", tool(0), args=json(record_id=F.col("target"))), _step("tool_result", "tool", tool(0), ok=True, output=json(record_id=F.col("target")))]
    call = _step("tool_call", "agent", tool(1), args=args)
    write = [call, _step("tool_result", "tool", tool(1), ok=True, output=receipt)]
    miss = [call, _step("tool_result", "tool", tool(1), ok=False, error="conflict: try again")]
    retry = [_step("message", "agent", content=F.lit("That failed; trying again."))]
    body = (
        F.when(kind == "phantom_action", F.array(*read))
        .when(kind == "error_ignored", F.array(*miss))
        .when(kind == "recovered", F.array(*miss, *retry, *write))
        .when(kind == "noisy", F.array(*read, *write))
        .otherwise(F.array(*write))
    )
    said = F.concat(F.lit("Done: "), F.col("target"), F.lit(" is set to "), F.col("value").cast("string"), F.lit("."))
    told = F.concat(F.lit("Set "), F.col("target"), F.lit(" to "), F.col("value").cast("string"), F.when(kind == "partial_completion", F.lit(" and tell the owner.")).otherwise(F.lit(".")))
    full = json(fields=F.struct(state.alias("value")), attendees=F.when(state != 0, F.array(guest(F.col("target")))), record_id=F.col("target"), start=F.lit("2026-03-02T09:00:00Z"), status=F.when(state == 0, "missing").otherwise("confirmed"), value=state, failed=F.when(F.col("label") == 1, 0).otherwise(1))
    probe = F.when(F.col("evidence") == "state_probe", F.array(_step("state_probe", "environment", tool(2), ok=True, output=full))).otherwise(F.array().cast(f"array<{STEP}>"))
    steps = F.concat(F.array(_step("message", "user", content=told), *read), body, F.array(_step("message", "agent", content=said)), probe)
    claim = F.element_at(F.create_map(*(F.lit(x) for d, (t, _) in one.items() for x in (d, t))), F.col("domain"))
    subject = json(fields=F.struct(F.col("value").alias("value")), attendee_email=guest(F.col("target")), record_id=F.col("target"), file=F.col("target"), start=F.lit("2026-03-02T09:00:00Z"), duration_min=F.col("value"), value=F.col("value"))
    return rows.select(F.format_string("trace-%08d", F.col("id")).alias("trace_id"), "domain", "split", "kind", "evidence", "label", told.alias("instruction"), said.alias("final_text"), claim.alias("claim_type"), subject.alias("subject"), steps.alias("steps"))


def as_tables(made: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The traces, steps and claims tables of generated traces."""
    each = made.select("trace_id", F.posexplode("steps").alias("i", "s"))
    steps = each.select("trace_id", "i", "s.kind", "s.role", "s.name", "s.content", F.parse_json("s.args").alias("args"), "s.ok", F.parse_json("s.output").alias("output"), F.when(F.col("s.error").isNotNull(), F.parse_json(F.to_json(F.struct(F.col("s.error").alias("message"))))).alias("error"))
    claims = made.select("trace_id", F.lit(0).alias("claim_idx"), F.col("claim_type").alias("type"), F.parse_json("subject").alias("subject"))
    return made.select("trace_id", "domain", "instruction", "final_text"), steps, claims
