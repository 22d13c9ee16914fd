"""The evaluation report as one nested table: a row for each detector, with its figures on the whole and by split, domain, kind and evidence.

All cuts come from one pass: rows are counted by cut (GROUPING SETS), score, verdict and label, so what is shuffled follows the number of
distinct scores, and every figure, AUROC and calibration error included, is a sum over these counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scores import gate
from tracewright.operators.metrics import ece_bin

CUTS = ("split", "domain", "kind", "evidence")
FIGURES = ("n", "n_failure", "caught", "missed", "false_alarms", "sent_to_review", "abstained", "coverage", "accuracy_on_decided", "brier", "ece", "auroc")


def significant(x: Column, digits: int = 12) -> Column:
    """A double rounded to so many significant digits, so that the last bits of sums in another order don't show."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x).try_cast("double"))


def _counted(predictions: DataFrame, cuts: Sequence[str]) -> DataFrame:
    """detector, cut, key, p, verdict, abstain and the numbers of failures and successes among such rows."""
    rows = predictions.select("detector", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cuts), "p", "verdict", "abstain", "label")
    own = ["p", "verdict", "abstain"]
    sets = [["detector", *own], *(["detector", c, *own] for c in cuts)]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in ("detector", *cuts, *own)))
    counts = grouped.agg(*(F.grouping(c).alias(f"_g_{c}") for c in cuts), F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good"))
    cut = F.coalesce(*(F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in cuts), F.lit("all"))
    key = F.coalesce(*(F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in cuts), F.lit(""))
    return counts.select("detector", cut.alias("cut"), key.alias("key"), *own, "bad", "good").where("bad + good > 0")


def figures(predictions: DataFrame, cuts: Sequence[str] = CUTS) -> DataFrame:
    """detector, cut (all, or one of cuts), key and FIGURES of predictions (detector, the cuts, label, p, verdict, abstain).

    Rows whose label is neither 0 nor 1 don't count. A null key is ''. AUROC is null without both labels, the share of right ones 0 without decided
    ones. Rows without a score count in all but Brier score, calibration error and AUROC.
    """
    group = ["detector", "cut", "key"]
    cells = _counted(predictions, cuts).withColumn("bin", ece_bin(F.col("p")))
    v, n = F.col("verdict"), F.col("bad") + F.col("good")
    add = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    decided = v.isin("verified", "false_success")
    right = F.when(v == "verified", F.col("good")).when(v == "false_success", F.col("bad"))
    plain = cells.groupBy(*group).agg(
        F.sum(n).alias("n"), F.sum("bad").alias("n_failure"), add(F.col("bad"), v == "false_success").alias("caught"), add(F.col("bad"), v == "verified").alias("missed"), add(F.col("good"), v == "false_success").alias("false_alarms"),
        add(n, v == "unverifiable").alias("sent_to_review"), add(n, F.col("abstain")).alias("abstained"), add(n, decided).alias("_decided"), F.coalesce(F.sum(right), F.lit(0)).alias("_right"),
        (F.sum(F.col("bad") * F.col("p") * F.col("p") + F.col("good") * (F.col("p") - 1) * (F.col("p") - 1)) / F.sum(F.when(F.col("p").isNotNull(), n))).alias("brier"),
    )
    bins = cells.where("p IS NOT NULL").groupBy(*group, "bin").agg(F.sum(n).alias("n"), F.abs(F.sum(n * F.col("p")) - F.sum("good")).alias("gap"))
    ece = bins.groupBy(*group).agg((F.sum("gap") / F.sum("n")).alias("ece"))
    scores = cells.where("p IS NOT NULL").groupBy(*group, "p").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    below = F.coalesce(F.sum("bad").over(Window.partitionBy(*group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    areas = scores.withColumn("wins", F.col("good") * (below + F.col("bad") / 2)).groupBy(*group)
    auroc = areas.agg((F.sum("wins") / F.nullif(F.sum("good") * F.sum("bad"), F.lit(0))).alias("auroc"))
    out = plain.join(ece, group, "left").join(auroc, group, "left")
    out = out.withColumn("coverage", F.col("_decided") / F.col("n")).withColumn("accuracy_on_decided", F.when(F.col("_decided") > 0, F.col("_right") / F.col("_decided")).otherwise(0.0))
    return out.select(*group, *FIGURES)


def assemble(predictions: DataFrame, cuts: Sequence[str] = CUTS) -> DataFrame:
    """detector, whole (a struct of FIGURES) and by_<cut> (arrays of key and FIGURES, by key), numbers at 12 significant digits."""
    kinds = dict(figures(predictions, cuts).dtypes)
    tidy = [significant(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in FIGURES]
    each = figures(predictions, cuts).select("detector", "cut", "key", F.struct(*tidy).alias("f"))
    by = [F.array_sort(F.collect_list(F.when(F.col("cut") == c, F.struct("key", F.col("f").alias("figures"))))).alias(f"by_{c}") for c in cuts]
    return each.groupBy("detector").agg(F.max(F.when(F.col("cut") == "all", F.col("f"))).alias("whole"), *by)


def flat(report: DataFrame, cuts: Sequence[str] = CUTS) -> DataFrame:
    """The rows of an assembled report: detector, cut, key and FIGURES."""
    whole = report.select("detector", F.lit("all").alias("cut"), F.lit("").alias("key"), "whole.*")
    for c in cuts:
        whole = whole.unionByName(report.select("detector", F.explode(f"by_{c}").alias("x")).select("detector", F.lit(c).alias("cut"), "x.key", "x.figures.*"))
    return whole


def recorded_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions as a recorded run has them, as `figures` takes them: p is the calibrated score where there is one, and rows without a known outcome go."""
    p = F.coalesce("p_cal", "p_raw")
    return predictions.where("outcome IN ('success', 'failure')").select(
        "detector", "trace_id", "split", "domain", F.col("injection").alias("kind"), "evidence", (F.col("outcome") == "success").cast("int").alias("label"), p.alias("p"), gate(p, F.coalesce("abstain", F.lit(False))).alias("verdict"), F.coalesce("abstain", F.lit(False)).alias("abstain")
    )


def report_lines(report: DataFrame) -> DataFrame:
    """value: the JSON object of each detector, keys in order; a few hundred bytes for each cut, so a report is a small file."""
    return report.select(F.to_json(F.struct(*(F.col(c) for c in sorted(report.columns))), {"ignoreNullFields": "false"}).alias("value"))


def markdown(report: DataFrame) -> str:
    """The table of the whole figures, a line for each detector, by name."""
    number = lambda x: "n/a" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    rows = sorted(report.select("detector", "whole.*").collect(), key=lambda r: r.detector)  # a row for each detector
    lines = ["| detector | " + " | ".join(FIGURES) + " |", "|-" * (len(FIGURES) + 1) + "|"]
    return "\n".join(lines + ["| " + " | ".join([r.detector, *(number(r[c]) for c in FIGURES)]) + " |" for r in rows]) + "\n"
