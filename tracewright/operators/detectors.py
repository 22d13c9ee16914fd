"""Detectors: each gives (trace_id, detector, p, abstain, abstain_reason); then calibration, cascade, gate and results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scores import LogisticModel, Thresholds, confidence, gate, platt
from tracewright.functions.values import text
from tracewright.operators.rules import evaluate_claims, worst_outcomes
from tracewright.sources.packs import RulePack

#: Raw scores of the rules that settle a trace. Fixed values.
CONCLUSIVE = (0.03, 0.05, 0.97)
BASE_RATE = 0.6
_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register_detector(name: str, detector: Callable[..., DataFrame]) -> None:
    """A detector takes traces, steps and claims, by name, and returns trace_id, p, abstain and abstain_reason."""
    if name in _REGISTRY:
        raise ValueError(f"there is a detector {name} already")
    _REGISTRY[name] = detector


def get_detector(name: str) -> Callable[..., DataFrame]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown detector {name}; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def _out(df: DataFrame, name: str, p, abstain=None, reason=None) -> DataFrame:
    return df.select("trace_id", F.lit(name).alias("detector"), p.cast("double").alias("p"), (F.lit(False) if abstain is None else abstain).alias("abstain"), (F.lit(None) if reason is None else reason).cast("string").alias("abstain_reason"))


def trust_agent(traces: DataFrame, **_) -> DataFrame:
    return _out(traces, "trust-agent", F.lit(1.0))


def any_error(traces: DataFrame, steps: DataFrame, **_) -> DataFrame:
    """0 if a tool result failed or has an error that isn't empty, else 1."""
    empty = F.col("error").isNull() | text(F.col("error")).isin("", "{}", "[]", "0", "false", "null")
    bad = (F.col("kind") == "tool_result") & (F.coalesce(~F.col("ok"), F.lit(False)) | ~empty)
    first = steps.where(bad).groupBy("trace_id").agg(F.min("i").alias("step"))
    return _out(traces.join(first, "trace_id", "left"), "any-error", F.when(F.col("step").isNull(), 1.0).otherwise(0.0))


def rules(traces: DataFrame, steps: DataFrame, claims: DataFrame, packs: Sequence[RulePack], base_rate: float = BASE_RATE, **_) -> DataFrame:
    worst = worst_outcomes(evaluate_claims(claims, steps, traces, packs))
    return _out(worst, "rules", F.coalesce("p", F.lit(base_rate)), F.col("abstain"), F.when(F.col("abstain"), "no_rule"))


def classifier(features: DataFrame, model: LogisticModel, guard: bool = True, **_) -> DataFrame:
    """The logistic model over features; outside of its domains or without tool results it abstains with its base rate."""
    out = ~F.col("domain").isin(list(model.domains)) | (F.col("n_tool_results") == 0) if guard else F.lit(False)
    return _out(features, "classifier-lr", F.when(out, F.lit(model.base_rate)).otherwise(model.p_success()), out, F.when(out, "out_of_distribution"))


for _name, _detector in (("trust-agent", trust_agent), ("any-error", any_error), ("rules", rules), ("classifier-lr", classifier)):
    register_detector(_name, _detector)


def calibrate(scores: DataFrame, calibrators: DataFrame) -> DataFrame:
    """scores with p_calibrated: Platt scaling by detector (detector, a, b); null for those that abstain or have none."""
    return scores.join(calibrators.select("detector", "a", "b"), "detector", "left").withColumn("p_calibrated", F.when(~F.col("abstain") & F.col("a").isNotNull(), platt(F.col("p"), F.col("a"), F.col("b")))).drop("a", "b")


def calibrator_table(spark, calibrators: Mapping[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in calibrators.items()], "detector string, a double, b double")


def cascade(first: DataFrame, second: DataFrame, name: str = "cascade-offline", keep_open: bool = True) -> DataFrame:
    """The first detector's row where it is conclusive, else the second's; keep_open: traces that the second lacks stay with the first.

    What isn't conclusive is split off before the second detector's rows are joined, so a costly one need score no others.
    """
    settled = F.coalesce(~F.col("abstain"), F.lit(False)) & F.col("p").isin(*CONCLUSIVE)
    columns = [c for c in first.columns if c != "detector"]
    done = first.where(settled).select(*columns, F.lit(False).alias("passed_on"))
    left = first.where(~settled)
    other = second.select("trace_id", *(F.col(c).alias("_" + c) for c in columns if c != "trace_id"), F.lit(True).alias("_there"))
    rest = left.join(other, "trace_id", "left" if keep_open else "inner")
    rest = rest.select("trace_id", *(F.when(F.col("_there"), F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in columns if c != "trace_id"), F.lit(True).alias("passed_on"))
    return done.unionByName(rest).withColumn("detector", F.lit(name))


def judged_cascade(traces: DataFrame, rule_scores: DataFrame, judge: Callable[[DataFrame], DataFrame], calibrators: DataFrame | None = None, name: str = "cascade") -> DataFrame:
    """The rules' row where they are conclusive, else the judge's: trace_id, detector, p, abstain, abstain_reason, p_calibrated, latency_ms, cost_usd, cached, decided_by and sent_to_judge.

    judge takes the traces that are left, and no others, and returns trace_id, p, abstain, abstain_reason and, if it has them, latency_ms, cost_usd and cached. The rules' latency counts for
    all, the judge's for those that were sent. A trace that the judge gives no row for abstains with judge_missing. Each part is calibrated by its own calibrator
    (detectors rules and judge).
    """
    def full(scores: DataFrame, detector: str) -> DataFrame:
        given = lambda c, kind: (F.col(c) if c in scores.columns else F.lit(None)).cast(kind).alias(c)
        out = scores.select("trace_id", F.lit(detector).alias("detector"), F.col("p").cast("double").alias("p"), "abstain", given("abstain_reason", "string"), given("latency_ms", "double"), given("cost_usd", "double"), given("cached", "boolean"))
        return calibrate(out, calibrators) if calibrators is not None else out.withColumn("p_calibrated", F.lit(None).cast("double"))

    ruled = full(rule_scores, "rules")
    settled = F.coalesce(~F.col("abstain"), F.lit(False)) & F.coalesce(F.col("p").isin(*CONCLUSIVE), F.lit(False))
    zero = F.lit(0.0)
    tidy = lambda df, by: df.withColumns({"latency_ms": F.coalesce("latency_ms", zero), "cost_usd": F.coalesce("cost_usd", zero), "cached": F.coalesce("cached", F.lit(False)), "decided_by": F.lit(by), "sent_to_judge": F.lit(by == "judge")})
    done = tidy(ruled.where(settled), "rules")
    left = ruled.where(~settled).select("trace_id", F.coalesce("latency_ms", zero).alias("_ms"), F.coalesce("cost_usd", zero).alias("_usd"))
    asked = full(judge(traces.join(left.select("trace_id"), "trace_id", "left_semi")), "judge")
    rest = left.join(asked, "trace_id", "left").withColumns({"abstain_reason": F.when(F.col("abstain").isNull(), "judge_missing").otherwise(F.col("abstain_reason")), "abstain": F.coalesce("abstain", F.lit(True))})
    rest = tidy(rest, "judge").withColumns({"latency_ms": F.col("latency_ms") + F.col("_ms"), "cost_usd": F.col("cost_usd") + F.col("_usd")}).drop("_ms", "_usd")
    return done.unionByName(rest).withColumn("detector", F.lit(name))


def judge_share(cascaded: DataFrame, rules_wall: float, judge_wall: float) -> DataFrame:
    """n, sent, share and wall_s_per_1k of a cascade: the rules' wall-clock rate and the share of the judge's, which runs calls side by side, so that latencies don't add up to it."""
    out = cascaded.agg(F.count("*").alias("n"), F.count_if("sent_to_judge").alias("sent"))
    share = F.when(F.col("n") > 0, F.col("sent") / F.col("n")).otherwise(0.0)
    return out.select("n", "sent", share.alias("share"), (F.lit(rules_wall) + share * judge_wall).alias("wall_s_per_1k"))


def results(traces: DataFrame, scores: DataFrame, success: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """A result for each trace: verdict, p (calibrated where it can be), confidence; skipped without a success claim."""
    used = F.coalesce("p_calibrated", "p") if "p_calibrated" in scores.columns else F.col("p")
    claimed = success.select("trace_id").distinct()
    scored = traces.join(claimed, "trace_id", "left_semi").join(scores, "trace_id").withColumn("p_used", used)
    scored = scored.withColumn("verdict", gate(F.col("p_used"), F.col("abstain"), thresholds))
    done = scored.select("trace_id", "domain", "detector", "verdict", F.col("p_used").alias("p_success"), F.col("p").alias("p_success_raw"), "abstain", F.coalesce("abstain_reason", F.when(F.col("abstain"), "abstained")).alias("abstain_reason"), confidence(F.col("verdict"), F.col("p_used")).alias("confidence"))
    none = F.lit(None).cast("double")
    skipped = traces.join(claimed, "trace_id", "left_anti").select("trace_id", "domain", F.lit(None).cast("string").alias("detector"), F.lit("skipped").alias("verdict"), none.alias("p_success"), none.alias("p_success_raw"), F.lit(True).alias("abstain"), F.lit("no_success_claim").alias("abstain_reason"), none.alias("confidence"))
    return done.unionByName(skipped)


def review_queue(results: DataFrame) -> DataFrame:
    """What needs a human: unverifiable results, the least certain first."""
    return results.where("verdict = 'unverifiable'").withColumn("distance", F.abs(F.coalesce("p_success", F.lit(0.5)) - 0.5)).orderBy("distance", "trace_id")


def overview(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict", "domain").agg(F.count("*").alias("n"))
