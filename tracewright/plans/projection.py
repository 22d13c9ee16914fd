"""Traces, steps, claims and predictions as projections of the driver's tables, which hold no agent traces of their own.

A trace is a user of events, a step an event; the same columns are spelled in SQL in plans/sql.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.sources.packs import RulePack, parse_pack

PACK = """
pack: crm
version: 1
tools: ["crm.*"]
claims:
  updated:
    action: "crm.update"
    probe: "crm.get"
    receipt:
      record_id: {equals: "{subject.record_id}", as: string}
      k: {exists: true}
    probe_checks:
      status: {in: [confirmed, done]}
  created:
    action: "crm.c*"
    receipt:
      k: {equals: "{subject.k}", as: number}
      status: {matches: "^(pending|done)$"}
"""


def packs() -> list[RulePack]:
    return [parse_pack(PACK)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(options: list[str], k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(o) for o in options)), (k + 1).cast("int"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.when(F.col("event_type") == "click", "tool_call").when(F.col("event_type").isin("view", "error"), "tool_result").when(F.col("event_type") == "purchase", "state_probe").otherwise("message")
    k, record = F.col("k"), F.concat(F.lit("r"), (F.col("k") % 7).cast("string"))
    full = F.to_json(F.struct("k", record.alias("record_id"), _pick(["pending", "confirmed", "done", "queued", "open"], k % 5).alias("status")))
    e = e.withColumns({"kind": kind, "trace_id": F.concat(F.lit("u"), F.col("user_id").cast("string")), "i": (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")})
    message = F.col("kind") == "message"
    failed = F.col("event_type") == "error"
    return e.select(
        "trace_id", "i", "kind",
        F.when(message, F.when(k % 2 == 0, "user").otherwise("agent")).when(F.col("kind") == "tool_call", "agent").when(F.col("kind") == "tool_result", "tool").otherwise("environment").alias("role"),
        F.when(~message, F.concat(F.lit("crm."), _pick(["create", "update", "get", "search"], k % 4))).alias("name"),
        F.when(message, F.concat(F.lit("note "), k.cast("string"))).alias("content"),
        F.when(F.col("kind") == "tool_call", F.parse_json(F.to_json(F.struct("k", record.alias("record_id"))))).alias("args"),
        F.when(F.col("event_type") == "view", True).when(failed, False).when(F.col("kind") == "state_probe", k % 3 != 0).alias("ok"),
        F.when(F.col("event_type").isin("view", "purchase"), F.parse_json(full)).alias("output"),
        F.when(failed, F.when(k % 2 == 0, F.parse_json(F.lit('"not found"'))).otherwise(F.parse_json(F.to_json(F.struct(k.alias("code")))))).alias("error"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    n = F.col("user_id")
    text = lambda c: c.cast("string")
    tail = _pick(["It looks like all is well.", "Not yet updated the rest.", "You can sign off on this.", "I wasn't able to finish."], n % 4)
    return u.select(
        F.concat(F.lit("u"), text(n)).alias("trace_id"), n.alias("line_no"), _pick(["booking", "crm", "coding"], n % 3).alias("domain"), F.concat(F.lit("task "), text(n)).alias("task_id"),
        F.concat(F.lit("Set value "), text(n % 50), F.lit(" on r"), text(n % 7), F.lit(" before 12:30")).alias("instruction"),
        F.concat(F.lit("Updated "), text(n % 10), F.lit(" of "), text(n % 13), F.lit(" records. "), tail).alias("final_text"),
        _pick(["success", "failure", "success", "unknown", "failure"], n % 5).alias("gt_outcome"), F.lit("canary").alias("meta"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured claims: one or two for most users, none for each fifth one."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    n = F.col("user_id")
    one = lambda idx, type_, subject: F.struct(F.lit(idx).alias("claim_idx"), type_.alias("type"), subject.alias("subject"))
    record = F.to_json(F.struct(F.concat(F.lit("r"), (n % 7).cast("string")).alias("record_id")))
    first = F.when(n % 5 != 4, one(0, F.when(n % 7 == 6, "failed").otherwise("updated"), record))
    second = F.when((n % 5 != 4) & (n % 3 == 0), one(1, F.when(n % 4 == 1, "unmapped").otherwise("created"), F.to_json(F.struct((n % 10).alias("k")))))
    source = F.when(n % 9 == 2, "extracted").otherwise("structured")
    each = u.select(F.concat(F.lit("u"), n.cast("string")).alias("trace_id"), source.alias("source"), F.explode(F.filter(F.array(first, second), lambda x: x.isNotNull())).alias("c"))
    return each.select("trace_id", "c.claim_idx", "c.type", F.parse_json("c.subject").alias("subject"), "source")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two detectors for each labelled document, with scores by arithmetic on its id."""
    from tracewright.functions.scores import gate

    joined = table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    d = F.col("doc_id")
    score = F.struct(F.lit("a").alias("detector"), ((d * 7919) % 1000 / 1000.0).alias("p")), F.struct(F.lit("b").alias("detector"), ((d * 104729) % 100 / 100.0 * 0.5 + F.col("quality") * 0.4).alias("p"))
    each = joined.withColumn("x", F.explode(F.array(*score)))
    p = each.select(
        "doc_id", F.col("x.detector").alias("detector"), F.concat(F.lit("t"), d.cast("string")).alias("trace_id"), F.when(d % 5 < 3, "train").otherwise("test").alias("split"), F.col("lang").alias("domain"),
        F.when(F.col("toxic") == 1, "wrong_value").otherwise("wrong_target").alias("kind"), F.when(d % 2 == 0, "state_probe").otherwise("receipt_only").alias("evidence"), F.col("quality").alias("label"), F.col("x.p").alias("p"),
        (d % 17 == 0).alias("abstain"), (d % 1000 / 10.0).alias("latency_ms"), (d % 13 / 1e5).alias("cost_usd"), (d % 4 == 0).alias("cached"),
    )
    return p.withColumn("verdict", gate(F.col("p"), F.col("abstain")))
