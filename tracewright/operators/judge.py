"""The model judge: deterministic requests, cached answers, strict parsing. The transport is a function that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.values import kind, text
from tracewright.operators.transport import Policy, Send, call_all
from tracewright.sources.folders import pinned
from tracewright.sources.judge_cache import JudgeCache, cache_key

# What a judge may answer.
FAILURE_KINDS = ("none", "phantom_action", "error_ignored", "wrong_target", "wrong_value", "not_persisted", "partial_completion", "cannot_tell")
RATIONALE_LIMIT = 300
OUTPUT_LIMIT = 2000
ABSTAIN = ("no_api_key", "unknown_price", "budget_exhausted", "ledger_cap", "http_429", "http_5xx", "http_4xx", "timeout", "network", "invalid_response", "parse_error")
# End of fixed values.


def clipped(value: Column, limit: int = OUTPUT_LIMIT) -> Column:
    n = F.char_length(value)
    return F.when(n > limit, F.concat(F.substring(value, 1, limit), F.lit("…[truncated "), (n - limit).cast("string"), F.lit(" chars]"))).otherwise(value)


def render_steps(steps: DataFrame) -> DataFrame:
    """trace_id and the prompt text of its steps, a line for each, in order."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f" {name}="), c))
    line = F.concat_ws(
        "", F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.col("kind"), F.lit(" "), F.col("role")), part("name", F.col("name")), part("ok", F.col("ok").cast("string")),
        part("args", clipped(F.to_json("args"))), part("output", clipped(text(F.col("output")))), part("error", clipped(text(F.col("error")))), F.when(F.col("content").isNotNull(), F.concat(F.lit(": "), F.col("content"))),
    )
    lines = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("l"))
    return lines.select("trace_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("steps_text"))


def requests(traces: DataFrame, steps: DataFrame, claims: DataFrame, model: str, prompt: str, version: int = 1, max_tokens: int = 400) -> DataFrame:
    """trace_id, request (JSON text), request_sha256 and cache_key of each trace's call."""
    said = claims.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("claim_idx", F.concat(F.col("type"), F.lit(" "), F.to_json("subject")).alias("line")))).alias("l"))
    said = said.select("trace_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("claims_text"))
    joined = traces.join(render_steps(steps), "trace_id", "left").join(said, "trace_id", "left")
    body = F.concat_ws("\n", F.lit("INSTRUCTION"), "instruction", F.lit("STEPS"), "steps_text", F.lit("CLAIMS"), "claims_text", F.lit("FINAL MESSAGE"), "final_text")
    request = F.to_json(F.struct(F.lit(max_tokens).alias("max_tokens"), F.array(F.struct(F.lit(prompt).alias("content"), F.lit("system").alias("role")), F.struct(body.alias("content"), F.lit("user").alias("role"))).alias("messages"), F.lit(model).alias("model"), F.lit(0.0).alias("temperature")))
    out = joined.select("trace_id", request.alias("request"))
    return out.select("trace_id", "request", F.sha2("request", 256).alias("request_sha256"), cache_key(F.lit(model), F.lit(version), F.col("request")).alias("cache_key"))


def parse_judgments(answers: DataFrame, valid_steps: DataFrame) -> DataFrame:
    """trace_id, p, failure_kind, evidence_steps, rationale, rationale_truncated, invalid_citation, abstain and abstain_reason.

    answers: trace_id, content. valid_steps: trace_id, steps (array<bigint>). A bare JSON object or one in a Markdown fence; a missing
    key, wrong type, value out of range or unknown kind makes the answer abstain. A cited step that isn't there is only flagged.
    """
    fenced = F.regexp_extract(F.trim("content"), r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    v = F.try_parse_json(F.when(fenced != "", fenced).otherwise(F.trim("content")))
    get = lambda k, as_="variant": F.try_variant_get("v", f"$.{k}", as_)
    cited = get("evidence_steps", "array<variant>")
    whole = F.forall(cited, lambda s: F.coalesce(kind(s) == "BIGINT", F.lit(False)))
    p = get("p_success", "double")
    ok = (
        kind(F.col("v")).startswith("OBJECT")
        & kind(get("p_success")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        & p.between(0, 1)
        & (kind(get("failure_kind")) == "STRING")
        & get("failure_kind", "string").isin(*FAILURE_KINDS)
        & kind(get("evidence_steps")).startswith("ARRAY")
        & whole
        & (kind(get("rationale")) == "STRING")
    )
    parsed = answers.withColumn("v", v).withColumn("good", F.coalesce(ok, F.lit(False))).join(valid_steps, "trace_id", "left")
    steps = F.transform(cited, lambda s: F.try_variant_get(s, "$", "bigint"))
    rationale = get("rationale", "string")
    known = F.coalesce("steps", F.array().cast("array<bigint>"))
    good = lambda c: F.when(F.col("good"), c)
    return parsed.select(
        "trace_id", good(p).alias("p"), good(get("failure_kind", "string")).alias("failure_kind"), good(steps).alias("evidence_steps"), good(F.substring(rationale, 1, RATIONALE_LIMIT)).alias("rationale"),
        good(F.char_length(rationale) > RATIONALE_LIMIT).alias("rationale_truncated"), good(F.exists(steps, lambda s: ~F.array_contains(known, s))).alias("invalid_citation"),
        (~F.col("good")).alias("abstain"), F.when(~F.col("good"), "parse_error").alias("abstain_reason"),
    )


def ask(requests: DataFrame, cache: JudgeCache, connect: Callable[[], Send], policy: Policy = Policy(), real: bool = True) -> DataFrame:
    """Answers (trace_id, cache_key, content, usage, failure, attempts, latency_ms, cached) to requests (trace_id, request, cache_key); new ones are in the cache then.

    Cached requests are joined away before any call, and equal requests are asked once. What fails is an answer without content, which isn't cached.
    The answers are a table in the shared folder: reading them again asks nobody.
    """
    known = cache.read()
    misses = requests.join(known.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(F.min("request").alias("request"))
    asked = pinned(call_all(misses.repartition("cache_key"), connect, policy, real), "answers")
    hits = requests.select("trace_id", "cache_key").join(known, "cache_key").select("trace_id", "cache_key", "content", "usage", F.lit(None).cast("string").alias("failure"), F.lit(0).alias("attempts"), F.lit(0.0).alias("latency_ms"), F.lit(True).alias("cached"))
    new = requests.select("trace_id", "cache_key").join(asked, "cache_key").select("trace_id", "cache_key", "content", "usage", "failure", "attempts", "latency_ms", F.lit(False).alias("cached"))
    answers = pinned(hits.unionByName(new), "judged")
    cache.merge(asked)
    return answers
