"""Pre-registered questions about a set of predictions, each as one small table; and models that leave a domain out.

predictions: detector, trace_id, split, domain, kind, label (1: success), p (raw), p_used, verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scores import gate
from tracewright.operators.metrics import auroc, calibration, decision_stats
from tracewright.operators.training import fit_left_out, probabilities, vector
from tracewright.sources.folders import pinned

BASELINES = ("trust-agent", "any-error")


def cautious(predictions: DataFrame, detector: str) -> DataFrame:
    """Whether a detector misses the fewest and decides the fewest of those that are no baselines: one row, supported."""
    stats = decision_stats(predictions.where(~F.col("detector").isin(*BASELINES)), ["detector"])
    own = lambda c: F.max(F.when(F.col("detector") == detector, F.col(c)))
    return stats.agg(F.coalesce((own("missed") == F.min("missed")) & (own("coverage") == F.min("coverage")) & (F.count("*") > 1), F.lit(False)).alias("supported"))


def overconfident(predictions: DataFrame) -> DataFrame:
    """By detector, on the test split: most raw scores are extreme, and calibration lowers the calibration error."""
    test = predictions.where("split = 'test'")
    raw = calibration(test, ["detector"]).select("detector", "extremes_share", F.col("ece").alias("ece_raw"))
    used = calibration(test, ["detector"], p="p_used").select("detector", F.col("ece").alias("ece_calibrated"))
    return raw.join(used, "detector").withColumn("ok", (F.col("extremes_share") > 0.5) & (F.col("ece_calibrated") < F.col("ece_raw")))


def domain_loss(left_out: DataFrame, shipped: DataFrame) -> DataFrame:
    """By domain: the AUROC of the model that didn't see it, that of the shipped model, and whether the first is lower."""
    a = auroc(left_out, ["domain"], score="p").select("domain", F.col("auroc").alias("left_out_auroc"))
    b = auroc(shipped, ["domain"], score="p").select("domain", F.col("auroc").alias("shipped_auroc"))
    return a.join(b, "domain").withColumn("below", F.coalesce(F.col("left_out_auroc") < F.col("shipped_auroc"), F.lit(False)))


def fooled(predictions: DataFrame, kind: str) -> DataFrame:
    """By detector: the recall on false successes of a kind, the mean of the other kinds' own recalls, and whether the first is lower.

    Verdicts are those of the raw scores.
    """
    raw = predictions.where("label = 0").withColumn("caught", (gate(F.col("p"), F.lit(False)) == "false_success").cast("double"))
    recall = raw.groupBy("detector", "kind").agg(F.avg("caught").alias("recall"))
    own, other = F.avg(F.when(F.col("kind") == kind, F.col("recall"))), F.avg(F.when(F.col("kind") != kind, F.col("recall")))
    return recall.groupBy("detector").agg(own.alias("recall"), other.alias("other_recall")).withColumn("fooled", F.coalesce(F.col("recall") < F.col("other_recall"), F.lit(False)))


def leave_domain_out(rows: DataFrame, features: Sequence[str], c: float, domains: Sequence[str]) -> DataFrame:
    """trace_id, domain, label and p of each domain's rows by a model of the other domains."""
    names = list(dict.fromkeys(domains))
    part = F.coalesce(*(F.when(F.col("domain") == d, F.lit(k)) for k, d in enumerate(names)), F.lit(-1)).cast("long")
    each = rows.select("trace_id", "domain", F.col("label").cast("int").alias("label"), part.alias("part"), vector(features))
    each = pinned(each, "features")  # worked out once, for the fits and the scores
    fitted = fit_left_out(each.select("part", "label", "x"), features, [(c, k) for k in range(len(names))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, own in pdf.groupby("part"):
                if fitted[k] is not None:
                    yield own[["trace_id", "domain", "label"]].assign(p=probabilities(np.array(own["x"].tolist(), float), fitted[k]))

    return each.where("part >= 0").mapInPandas(run, "trace_id string, domain string, label int, p double")
