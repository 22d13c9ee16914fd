"""Evaluation of scores against labels, grouped by any columns (by none for the whole).

Labels are 1 for a success unless said otherwise, p is the probability of success. AUROC needs the average rank of each
score; it comes from counts by distinct score, so the ordered window sees one row for each score and group, not each trace.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ranks import running_sums

#: Edges of ten equal bins as they come out in doubles: i * 0.1. Fixed values (three differ from i / 10).
ECE_EDGES = tuple(float(x) for x in np.linspace(0.0, 1.0, 11))
EXTREME_LOW, EXTREME_HIGH = 0.05, 0.95


def auroc(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """by, n_pos, n_neg and auroc (ties count half; null without both classes)."""
    keys = list(by)
    counts = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(w), F.lit(0))
    wins = counts.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2.0))
    out = wins.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins").alias("wins"))
    return out.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg")))).drop("wins")


def ece_bin(p: Column) -> Column:
    """The bin of a probability: left-closed, the last one closed."""
    out = F.lit(9)
    for k in range(8, -1, -1):
        out = F.when(p < ECE_EDGES[k + 1], F.lit(k)).otherwise(out)
    return out


def reliability(df: DataFrame, by: Sequence[str] = (), label: str = "label", p: str = "p") -> DataFrame:
    """by, bin, n, mean_p and share of successes of each bin that isn't empty."""
    return df.withColumn("bin", ece_bin(F.col(p))).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("share"))


def calibration(df: DataFrame, by: Sequence[str] = (), label: str = "label", p: str = "p") -> DataFrame:
    """by, n, ece, brier and the share of extreme probabilities."""
    y = F.col(label).cast("double")
    bins = df.withColumn("bin", ece_bin(F.col(p))).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col(p) - y, 2)).alias("sq"), F.count_if((F.col(p) < EXTREME_LOW) | (F.col(p) > EXTREME_HIGH)).alias("ext")
    )
    out = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"), F.sum("sq").alias("sq"), F.sum("ext").alias("ext"))
    return out.select(*by, "n", (F.col("gap") / F.col("n")).alias("ece"), (F.col("sq") / F.col("n")).alias("brier"), (F.col("ext") / F.col("n")).alias("extremes_share"))


def decision_stats(df: DataFrame, by: Sequence[str] = (), label: str = "label", verdict: str = "verdict") -> DataFrame:
    """Counts and shares of verdicts against labels; with no rows to divide by a share is 0."""
    ok, v = F.col(label) == 1, F.col(verdict)
    decided = v.isin("verified", "false_success")
    right = (ok & (v == "verified")) | (~ok & (v == "false_success"))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failure"), F.count_if(decided).alias("decided"), F.count_if(right).alias("right"),
        F.count_if(~ok & (v == "false_success")).alias("caught"), F.count_if(~ok & (v == "verified")).alias("missed"), F.count_if(ok & (v == "false_success")).alias("false_alarms"),
        F.count_if(v == "unverifiable").alias("sent_to_review"), F.count_if(ok & (v == "verified")).alias("success_verified"), F.count_if(ok & (v == "unverifiable")).alias("success_unverifiable"), F.count_if(~ok & (v == "unverifiable")).alias("failure_unverifiable"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("coverage", share("decided", "n")).withColumn("accuracy_on_decided", share("right", "decided")).drop("decided", "right")


def evaluation_rows(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Results with the label of their trace; skipped ones, unknown labels and results without a score are left out."""
    known = labels.where("outcome IN ('success', 'failure')").select("trace_id", (F.col("outcome") == "success").cast("int").alias("label"))
    return results.where("verdict != 'skipped' AND p IS NOT NULL").join(known, "trace_id")


def evaluate(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All of the above of rows (label, p, verdict), a line for each group."""
    keys = list(by) or ["_all"]
    df = rows if by else rows.withColumn("_all", F.lit(0))
    out = decision_stats(df, keys).join(calibration(df, keys).drop("n"), keys).join(auroc(df, keys, score="p").select(*keys, "auroc"), keys)
    return out if by else out.drop("_all")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by and q0, q1, ...: exact quantiles with linear interpolation, by ranks over the whole table, so that no task holds a group's values."""
    keys = F.struct(*(F.col(c) for c in by))
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_by", F.to_json(keys, {"ignoreNullFields": "false"})).groupBy(*by, "_by", "_v").agg(F.count("*").alias("_n"))
    placed = running_sums(rows, [F.col("_by"), F.col("_v")], ["_n"])
    sizes = placed.groupBy("_by").agg(F.min("_n_before").alias("_first"), F.sum("_n").alias("_all"))
    at = placed.join(sizes, "_by").withColumn("_from", F.col("_n_before") - F.col("_first"))
    aggs = []
    for k, share in enumerate(shares):
        place = (F.col("_all") - 1) * F.lit(float(share))
        holds = lambda x: (F.col("_from") <= x) & (x < F.col("_from") + F.col("_n"))
        low, high = (F.max(F.when(holds(x), F.col("_v"))) for x in (F.floor(place), F.ceil(place)))
        rest = F.max(place - F.floor(place))
        aggs.append((low + (high - low) * rest).alias(f"q{k}"))
    return at.groupBy(*by).agg(*aggs)


def latency_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """p50 and p95 of latency_ms, seconds and USD for 1,000 traces, of rows that weren't answered from a cache. Groups by columns that aren't null."""
    fresh = lambda c: F.when(~F.col("cached"), F.col(c))
    sums = df.groupBy(*by).agg(F.avg(fresh("latency_ms")).alias("wall_s_per_1k"), (F.avg(fresh("cost_usd")) * 1000).alias("usd_per_1k"))
    places = quantiles(df.where("NOT cached"), by, "latency_ms", (0.5, 0.95)).withColumnsRenamed({"q0": "p50_ms", "q1": "p95_ms"})
    return sums.join(places, list(by), "left")


def bootstrap_auroc(df: DataFrame, by: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """The 2.5th and 97.5th percentile of the AUROC over stratified resamples, for each detector.

    What is resampled are the counts by distinct score, so a group is as large as its distinct scores, not its traces.
    """
    counts = df.groupBy(by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        pos, neg = pdf["pos"].to_numpy(), pdf["neg"].to_numpy()
        low = high = None
        if pos.sum() and neg.sum():
            rng = np.random.default_rng(seed)
            p = rng.multinomial(pos.sum(), pos / pos.sum(), rounds)
            n = rng.multinomial(neg.sum(), neg / neg.sum(), rounds)
            area = (p * (np.cumsum(n, 1) - n / 2)).sum(1) / (pos.sum() * neg.sum())
            low, high = np.percentile(area, [2.5, 97.5])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "low": [low], "high": [high]})

    return counts.groupBy(by).applyInPandas(run, f"{by} string, low double, high double")
