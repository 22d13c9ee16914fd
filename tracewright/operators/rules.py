"""The rule engine: rule packs compiled to column expressions, claims joined to calls, receipts and probes.

Inputs are claims (trace_id, claim_idx, type, subject VARIANT), steps (see steps.py) and traces (trace_id, domain). All joins
are equi-joins on trace_id; the last passing call, contradicting call and probe are max_by over structs, so a group
is combined before it is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.patterns import java_regex, matches_glob
from tracewright.functions.values import constant, equal, get_path, is_text, kind, python_text, text
from tracewright.operators.steps import call_results
from tracewright.sources.packs import Check, RulePack

#: Outcomes from worst to best with the raw score of a trace (none: abstain). Fixed values.
OUTCOMES = {"contradicted": 0.03, "unsupported": 0.05, "unknown": None, "receipt_only": 0.70, "probe_supported": 0.97}
_PLACEHOLDER = re.compile(r"\{(subject|args)\.([^{}]*)\}")


def _expected(value: object, subject: Column, args: Column) -> tuple[Column, Column]:
    """The expected value as VARIANT, and whether all fields that it names are there."""
    if not isinstance(value, str):
        return constant(value), F.lit(True)
    source = {"subject": subject, "args": args}
    whole = _PLACEHOLDER.fullmatch(value)
    if whole:
        found = get_path(source[whole[1]], whole[2])
        return found, found.isNotNull()
    parts, there, at = [], F.lit(True), 0
    for m in _PLACEHOLDER.finditer(value):
        found = get_path(source[m[1]], m[2])
        parts += [F.lit(value[at : m.start()]), python_text(found)]
        there = there & found.isNotNull()
        at = m.end()
    if not parts:
        return constant(value), F.lit(True)
    joined = F.concat(*parts, F.lit(value[at:]))
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(joined.alias("v")))), "$.v", "variant"), there


def compile_check(check: Check, subject: Column, args: Column, output: Column) -> Column:
    """pass, fail or skipped: a field that is missing fails any check but exists; a placeholder that is missing skips it."""
    field = get_path(args, check.path[5:]) if check.path == "args" or check.path.startswith("args.") else get_path(output, check.path)
    found = field.isNotNull()
    verdict = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    if check.op == "exists":
        return verdict(found == F.lit(bool(check.value)))
    if check.op == "matches":
        return F.when(~found, "fail").otherwise(verdict(text(field).rlike(java_regex(check.value))))
    if check.op == "in":
        items = [_expected(v, subject, args) for v in check.value]
        there, hit = F.lit(True), F.lit(False)
        for value, ok in items:
            there, hit = there & ok, hit | equal(field, value, check.form)
        return F.when(~found, "fail").when(~there, "skipped").otherwise(verdict(hit))
    value, there = _expected(check.value, subject, args)
    if check.op == "equals":
        return F.when(~found, "fail").when(~there, "skipped").otherwise(verdict(equal(field, value, check.form)))
    pairs = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    own = F.try_variant_get(field, "$", "map<string,variant>")
    holds = kind(value).startswith("OBJECT") & F.forall(pairs(value), lambda e: F.coalesce(equal(own[e["key"]], e["value"], check.form), F.lit(False)) & own[e["key"]].isNotNull())
    inside = F.contains(F.try_variant_get(field, "$", "string"), python_text(value))
    member = F.exists(F.try_variant_get(field, "$", "array<variant>"), lambda x: equal(x, value, check.form))
    contains = F.when(kind(field).startswith("OBJECT"), holds).when(is_text(field), inside).when(kind(field).startswith("ARRAY"), member).otherwise(F.lit(False))
    return F.when(~found, "fail").when(~there, "skipped").otherwise(verdict(contains))


def _checks(checks: Sequence[Check], subject: Column, args: Column, output: Column) -> Column:
    return F.array(*(compile_check(c, subject, args, output) for c in checks)).cast("array<string>")


def applicable_packs(steps: DataFrame, traces: DataFrame, packs: Sequence[RulePack]) -> DataFrame:
    """trace_id and packs: the names of those that have a tool among the trace's calls, or whose domain the trace has if it calls nothing."""
    calls = steps.where("kind = 'tool_call'").groupBy("trace_id").agg(*(F.max(matches_glob(F.col("name"), list(p.tools))).alias(f"p{k}") for k, p in enumerate(packs)), F.lit(True).alias("calls"))
    joined = traces.select("trace_id", "domain").join(calls, "trace_id", "left")
    named = F.array(*(F.when(F.coalesce(F.when(F.col("calls"), F.col(f"p{k}")), F.col("domain") == p.name, F.lit(False)), F.lit(p.name)) for k, p in enumerate(packs)))
    return joined.select("trace_id", F.filter(named.cast("array<string>"), lambda x: x.isNotNull()).alias("packs"))


def claim_rules(claims: DataFrame, applicable: DataFrame, packs: Sequence[RulePack]) -> DataFrame:
    """claims with rule, "pack.type" of the first applicable pack that has a rule for the claim's type, else null."""
    rule = F.lit(None).cast("string")
    for p in reversed(packs):
        for t in p.claims:
            rule = F.when(F.array_contains("packs", p.name) & (F.col("type") == t), F.lit(f"{p.name}.{t}")).otherwise(rule)
    joined = claims.join(applicable, "trace_id", "left").withColumn("packs", F.coalesce("packs", F.array().cast("array<string>")))
    return joined.withColumn("rule", rule).drop("packs")


def evaluate_claims(claims: DataFrame, steps: DataFrame, traces: DataFrame, packs: Sequence[RulePack]) -> DataFrame:
    """trace_id, claim_idx, type, rule, outcome, step (the step that is cited), checks (of receipt and probe) and missing_subject."""
    rules = {f"{p.name}.{t}": r for p in packs for t, r in p.claims.items()}
    ruled = claim_rules(claims.select("trace_id", "claim_idx", "type", "subject"), applicable_packs(steps, traces, packs), packs)
    calls = call_results(steps)

    def by_rule(make, otherwise: Column) -> Column:
        out = otherwise
        for name, rule in rules.items():
            out = F.when(F.col("rule") == name, make(rule)).otherwise(out)
        return out

    none = F.array().cast("array<string>")
    met = ruled.where("rule IS NOT NULL").join(calls, "trace_id").where(by_rule(lambda r: matches_glob(F.col("name"), [r.action]), F.lit(False)))
    met = met.withColumn("checks", by_rule(lambda r: _checks(r.receipt, F.col("subject"), F.col("args"), F.col("output")), none))
    bad = F.array_contains("checks", "fail")
    wrong = F.coalesce(~F.col("ok"), F.lit(False)) | F.col("error").isNotNull() | bad
    passes = F.col("result_i").isNotNull() & F.coalesce(F.col("ok"), F.lit(False)) & F.col("error").isNull() & ~bad
    evidence = F.struct("result_i", "args", "checks")
    best = met.groupBy("trace_id", "claim_idx").agg(
        F.max_by(evidence, F.when(passes, F.col("call_i"))).alias("good"), F.max_by(evidence, F.when(F.col("result_i").isNotNull() & wrong, F.col("call_i"))).alias("bad")
    )
    probes = steps.where("kind = 'state_probe'").select("trace_id", F.col("i").alias("probe_i"), F.col("name").alias("probe_name"), F.col("ok").alias("probe_ok"), F.col("output").alias("probe_output"), F.col("error").alias("probe_error"))
    seen = ruled.where("rule IS NOT NULL").select("trace_id", "claim_idx", "rule").join(probes, "trace_id")
    seen = seen.where(by_rule(lambda r: matches_glob(F.col("probe_name"), [r.probe]) if r.probe else F.lit(False), F.lit(False)))
    last = seen.groupBy("trace_id", "claim_idx").agg(F.max_by(F.struct("probe_i", "probe_ok", "probe_output", "probe_error"), "probe_i").alias("p"))
    out = ruled.join(best, ["trace_id", "claim_idx"], "left").join(last, ["trace_id", "claim_idx"], "left")
    out = out.withColumn("probe_checks", F.when(F.col("p").isNotNull() & F.col("good").isNotNull(), by_rule(lambda r: _checks(r.probe_checks, F.col("subject"), F.col("good.args"), F.col("p.probe_output")), none)))
    denied = F.coalesce(~F.col("p.probe_ok"), F.lit(False)) | F.col("p.probe_error").isNotNull() | F.array_contains("probe_checks", "fail")
    everything = F.concat("good.checks", "probe_checks")
    skipped = (F.size(everything) > 0) & F.forall(everything, lambda c: c == "skipped")
    good = F.col("good").isNotNull()
    outcome = (
        F.when(F.col("rule").isNull(), "unknown")
        .when(good & F.col("p").isNull(), "receipt_only")
        .when(good & denied, "contradicted")
        .when(good & skipped, "receipt_only")
        .when(good, "probe_supported")
        .when(F.col("bad").isNotNull(), "contradicted")
        .otherwise("unsupported")
    )
    out = out.withColumn("outcome", outcome)
    cites_probe = good & F.col("p").isNotNull() & ~(F.col("outcome") == "receipt_only")
    step = F.when(cites_probe, F.col("p.probe_i")).when(good, F.col("good.result_i")).when(F.col("outcome") == "contradicted", F.col("bad.result_i"))
    checks = F.when(good, F.concat(F.col("good.checks"), F.coalesce("probe_checks", none))).when(F.col("bad").isNotNull(), F.col("bad.checks")).otherwise(none)
    return out.select("trace_id", "claim_idx", "type", "rule", "outcome", step.alias("step"), checks.alias("checks"), F.array_contains(checks, "skipped").alias("missing_subject"))


def worst_outcomes(outcomes: DataFrame) -> DataFrame:
    """trace_id, outcome, raw score p and abstain of each trace: the worst of its claims, of equal ones the first."""
    place = F.lit(None).cast("int")
    score = F.lit(None).cast("double")
    for k, (name, p) in enumerate(OUTCOMES.items()):
        place = F.when(F.col("outcome") == name, F.lit(k)).otherwise(place)
        score = F.when(F.col("outcome") == name, F.lit(p).cast("double")).otherwise(score)
    worst = outcomes.groupBy("trace_id").agg(F.min_by(F.struct("outcome", "claim_idx", "step"), F.struct(place, F.col("claim_idx"))).alias("w"))
    return worst.select("trace_id", "w.outcome", F.col("w.claim_idx").alias("claim_idx"), F.col("w.step").alias("step")).withColumn("p", score).withColumn("abstain", F.col("p").isNull())
