"""Operators on the steps of traces: pairing of results and calls, probe merge, features.

Steps are rows (trace_id, i, kind, role, name, content, args, ok, output, error), the last values as VARIANT. Windows and
groups are by trace_id, so one exchange serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.values import is_text, kind, text

# Fixed values of the features: word lists and the pattern of value tokens.
WRITE_VERBS = "create|update|book|send|write|commit|set|apply|post|put|patch|delete"
ERROR_WORDS = ("expired", "invalid", "conflict", "not found", "denied", "timeout", "rejected", "failed")
STATUS_WORDS = ("pending", "queued", "accepted")
NOT_FOUND_WORDS = ("not found", "not_found")
REVIEWER_PHRASES = (
    "flagging for human review",
    "logging this for the audit trail",
    "internal note: task closed",
    "fyi, this is finished",
    "heads up, wrapping this up",
    "safe to mark resolved",
    "this can be closed out now",
    "marking as resolved for tracking",
    "no action required from you",
    "closing this one out",
    "for tracking purposes: task complete",
    "you can sign off on this",
)
HEDGE_WORDS = ("i think", "i believe", "it looks like", "as far as i can tell", "should be", "probably", "seems", "likely", "presumably", "hopefully")
VALUE_TOKEN = (
    r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?:\d{2})?(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?)?"
    r"|\b\d{1,2}:\d{2}(?::\d{2})?\b"
    r"|\b\d+(?:\.\d+)?\b"
)
# End of fixed values.

FEATURES = (
    "n_steps", "n_tool_calls", "n_tool_results", "n_state_probes", "n_agent_messages", "n_failed_results", "failed_result_share", "last_result_succeeded",
    "failure_after_last_write", "n_write_calls", "n_read_calls", "write_success_ratio", "last_write_succeeded", "n_retries", "receipt_id_present", "steps_after_last_write",
    "probe_present", "probe_succeeded", "probe_empty_or_not_found", "error_keyword_hits", "pending_status_present", "reviewer_phrase_present", "n_claims",
    "claims_extracted_from_text", "hedge_words_present", "final_text_length", "unsupported_value_ratio", "instruction_value_coverage",
)


def failed() -> Column:
    return F.coalesce(~F.col("ok"), F.lit(False)) | F.col("error").isNotNull()


def succeeded() -> Column:
    return F.coalesce(F.col("ok"), F.lit(False)) & F.col("error").isNull()


def pair_results(steps: DataFrame) -> DataFrame:
    """Steps with call_i: for a tool result, the nearest earlier call of the same name in its trace; null for an orphan."""
    w = Window.partitionBy("trace_id", "name").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    call = F.last(F.when(F.col("kind") == "tool_call", F.col("i")), ignorenulls=True).over(w)
    return steps.withColumn("call_i", F.when((F.col("kind") == "tool_result") & F.col("name").isNotNull(), call))


def call_results(steps: DataFrame) -> DataFrame:
    """Calls with their result: of several results of one call the last one counts.

    trace_id, call_i, name, args, and result_i, ok, output, error (null without a result).
    """
    steps = steps.repartition("trace_id")
    paired = pair_results(steps).where("kind = 'tool_result' AND call_i IS NOT NULL")
    last = paired.groupBy("trace_id", "call_i").agg(F.max_by(F.struct(F.col("i").alias("result_i"), "ok", "output", "error"), "i").alias("r"))
    calls = steps.where("kind = 'tool_call'").select("trace_id", F.col("i").alias("call_i"), "name", "args")
    return calls.join(last, ["trace_id", "call_i"], "left").select("trace_id", "call_i", "name", "args", "r.*")


def merge_probes(steps: DataFrame, probes: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps with the probes (trace_id, line_no, name, ok, ts, args, output, error) appended to their traces in file order
    (files by name, if probes have file), and the probes whose trace isn't there.
    """
    last = steps.groupBy("trace_id").agg(F.max("i").alias("last_i"))
    known = probes.join(traces.select("trace_id"), "trace_id", "left_semi").join(last, "trace_id", "left")
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy(*(c for c in ("file", "line_no") if c in probes.columns)))
    added = known.withColumn("i", (F.coalesce("last_i", F.lit(-1)) + place).cast(steps.schema["i"].dataType)).withColumns({"kind": F.lit("state_probe"), "role": F.lit("environment"), "content": F.lit(None).cast("string")})
    return steps.unionByName(added.select(*(c for c in steps.columns if c in added.columns)), allowMissingColumns=True), probes.join(traces.select("trace_id"), "trace_id", "left_anti")


def _blob(value: Column) -> Column:
    """Search text of a value: its lower-cased text, empty for null."""
    return F.lower(F.coalesce(text(value), F.lit("")))


def _any(blob: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | blob.contains(w)
    return hit


def _has_id(output: Column) -> Column:
    """Whether an object has a value other than null and "" under id, sha or a key that ends in _id."""
    raw = F.when(kind(output).startswith("OBJECT"), F.to_json(output))
    keys = F.filter(F.json_object_keys(raw), lambda k: (k == "id") | (k == "sha") | k.endswith("_id"))
    values = F.from_json(raw, "map<string,string>")
    return F.coalesce(F.exists(keys, lambda k: F.coalesce(values[k], F.lit("")) != ""), F.lit(False))


def value_share(source: Column, haystack: Column, empty: float) -> Column:
    """The share of the value tokens (dates, times, numbers) of a text that a lower-cased haystack holds."""
    tokens = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(VALUE_TOKEN), F.lit(0))
    hits = F.size(F.filter(tokens, lambda t: F.contains(haystack, F.lower(t))))
    return F.when(F.size(tokens) == 0, F.lit(empty)).otherwise(hits / F.size(tokens))


def features(steps: DataFrame, traces: DataFrame, claims: DataFrame) -> DataFrame:
    """trace_id, domain and the 28 FEATURES of each trace.

    traces: trace_id, domain, instruction, final_text. claims: trace_id, source (structured or extracted).
    What a step's values say is settled where steps are read, so that flags and search texts are shuffled and not values; then
    windows by trace, and one conditional aggregation.
    """
    is_ = lambda k: F.col("kind") == k
    results, calls, probes = is_("tool_result"), is_("tool_call"), is_("state_probe")
    out = F.when(results | probes, _blob(F.col("output")))
    empty = F.col("output").isNull() | F.to_json("output").isin("{}", "[]", '""', "null")
    read = steps.withColumns({"write": F.coalesce(F.col("name").rlike(f"(?i){WRITE_VERBS}"), F.lit(False)), "bad": failed(), "good": succeeded(), "evidence": out})
    read = read.withColumn("blob", F.when(results | probes, F.concat("evidence", F.lit(" "), _blob(F.col("error")))))
    said_by = lambda which, words: F.coalesce(which & _any(F.col("blob"), words), F.lit(False))
    read = read.select(
        "trace_id", "i", "kind", "name", "write", "bad", "good", "evidence", (is_("message") & F.coalesce(F.col("role") == "agent", F.lit(False))).alias("spoken"),
        F.when(calls & F.col("write"), _blob(F.col("args"))).alias("asked"), F.when(results & F.col("write"), _has_id(F.col("output"))).alias("receipt"),
        F.when(probes, empty | said_by(probes, NOT_FOUND_WORDS)).alias("nothing"), said_by(results, ERROR_WORDS).alias("hit"),
        said_by(results, STATUS_WORDS).alias("pending"), said_by(results, REVIEWER_PHRASES).alias("reviewer"),
    )
    whole = Window.partitionBy("trace_id")
    # One exchange for all: a trace's steps are together, and so are those of one name.
    paired = pair_results(read.repartition("trace_id"))
    # The next step that is no message, seen from each step: backwards the frame only grows, so a long trace takes linear time.
    follow = Window.partitionBy("trace_id").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    write = F.col("write")
    rows = paired.withColumns(
        {
            "next": F.last(F.when(~is_("message"), F.struct("kind", "name")), ignorenulls=True).over(follow),
            "last_ok_write": F.max(F.when(results & write & F.col("good"), F.col("i"))).over(whole),
            "last_write_call": F.max(F.when(calls & write, F.col("i"))).over(whole),
        }
    )
    n = lambda c: F.count_if(c).cast("double")
    flag = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)).cast("double")
    last = lambda what, when: F.coalesce(F.max_by(F.struct(F.col(what).cast("int").alias("x")), F.when(when, F.col("i")))["x"], F.lit(0)).cast("double")
    retry = results & (F.coalesce("name", F.lit("")) != "") & F.col("bad") & F.coalesce((F.col("next")["kind"] == "tool_call") & (F.col("next")["name"] == F.col("name")), F.lit(False))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    joined = lambda c: F.concat_ws(" ", F.collect_list(c))
    agg = rows.groupBy("trace_id").agg(
        n(F.lit(True)).alias("n_steps"), n(calls).alias("n_tool_calls"), n(results).alias("n_tool_results"), n(probes).alias("n_state_probes"),
        n(F.col("spoken")).alias("n_agent_messages"), n(results & F.col("bad")).alias("n_failed_results"), last("good", results).alias("last_result_succeeded"),
        flag(results & F.col("bad") & F.coalesce(F.col("i") > F.col("last_ok_write"), F.lit(False))).alias("failure_after_last_write"),
        n(calls & write).alias("n_write_calls"), n(calls & ~write).alias("n_read_calls"),
        n(results & write & F.col("good")).alias("ok_writes"), n(results & write).alias("writes"),
        last("good", results & (F.col("call_i") == F.col("last_write_call"))).alias("last_write_succeeded"),
        n(retry).alias("n_retries"), flag(F.col("receipt")).alias("receipt_id_present"),
        n(F.coalesce(F.col("i") > F.col("last_write_call"), F.lit(False))).alias("steps_after_last_write"),
        flag(probes).alias("probe_present"), last("good", probes).alias("probe_succeeded"), last("nothing", probes).alias("probe_empty_or_not_found"),
        n(F.col("hit")).alias("error_keyword_hits"), flag(F.col("pending")).alias("pending_status_present"), flag(F.col("reviewer")).alias("reviewed"),
        joined("evidence").alias("evidence"), joined("asked").alias("asked"),
    )
    extracted = F.max((F.col("source") == "extracted").cast("double")) if "source" in claims.columns else F.lit(0.0)
    claimed = claims.groupBy("trace_id").agg(F.count("*").cast("double").alias("claims"), extracted.alias("claims_extracted"))
    said = F.lower(F.coalesce("final_text", F.lit("")))
    out = traces.join(agg, "trace_id", "left").join(claimed, "trace_id", "left").fillna("", ["evidence", "asked"])
    out = out.withColumns(
        {
            "failed_result_share": share("n_failed_results", "n_tool_results"),
            "write_success_ratio": share("ok_writes", "writes"),
            "reviewer_phrase_present": F.greatest(F.coalesce("reviewed", F.lit(0.0)), _any(said, REVIEWER_PHRASES).cast("double")),
            "n_claims": F.coalesce("claims", F.lit(0.0)),
            "claims_extracted_from_text": F.coalesce("claims_extracted", F.lit(0.0)),
            "hedge_words_present": _any(said, HEDGE_WORDS).cast("double"),
            "final_text_length": F.char_length(F.coalesce("final_text", F.lit(""))).cast("double"),
            "unsupported_value_ratio": 1 - value_share(F.col("final_text"), F.col("evidence"), 1.0),
            "instruction_value_coverage": value_share(F.col("instruction"), F.col("asked"), 1.0),
        }
    )
    return out.select("trace_id", "domain", *(F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES))


__all__ = ["FEATURES", "call_results", "failed", "features", "is_text", "merge_probes", "pair_results", "succeeded", "value_share"]
