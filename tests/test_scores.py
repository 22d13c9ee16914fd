"""Metrics, gate, calibration and costs on values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions.scores import Thresholds, gate, platt
from tracewright.operators import costs, metrics, training


def rows(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


@pytest.mark.parametrize(("labels", "scores", "want"), [([1, 1, 0, 0], [3.0, 2.0, 2.0, 1.0], 0.875), ([1, 0], [0.5, 0.5], 0.5), ([1, 1], [0.1, 0.2], None)])
def test_auroc(spark, labels, scores, want):
    assert metrics.auroc(rows(spark, labels, scores)).first().auroc == want


def test_calibration(spark):
    df = rows(spark, [0, 0, 1, 1], [0.05, 0.05, 0.95, 0.95]).withColumnRenamed("score", "p")
    got = metrics.calibration(df).first()
    assert got.ece == pytest.approx(0.05) and got.brier == pytest.approx(0.0025) and got.extremes_share == 0


@pytest.mark.parametrize(("p", "want"), [(0.0, 0), (0.3, 2), (0.6, 5), (0.7, 6), (0.8, 8), (1.0, 9)])
def test_bins_have_the_edges_of_doubles(spark, p, want):
    assert spark.range(1).select(metrics.ece_bin(F.lit(p)).alias("b")).first().b == want


def test_decisions(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1], ["false_success", "verified", "unverifiable", "verified"])), "label int, verdict string")
    got = metrics.decision_stats(df).first()
    assert (got.coverage, got.accuracy_on_decided, got.caught, got.missed) == (0.75, 1.0, 1, 0)


def test_gate(spark):
    ps = [(0.8, False), (0.2, False), (0.5, False), (0.9, True)]
    df = spark.createDataFrame(ps, "p double, abstain boolean")
    assert [r.v for r in df.select(gate(F.col("p"), F.col("abstain")).alias("v")).collect()] == ["verified", "false_success", "unverifiable", "unverifiable"]
    with pytest.raises(ValueError):
        Thresholds(0.2, 0.8)


@pytest.mark.parametrize(("p", "want"), [(0.03, 0.0502), (0.05, 0.0749), (0.70, 0.6299), (0.97, 0.9336)])
def test_platt(spark, p, want):
    a, b = 0.8031373186446822, -0.14878284439448436
    assert spark.range(1).select(platt(F.lit(p), a, b).alias("q")).first().q == pytest.approx(want, abs=5e-5)


def test_fit_platt_finds_the_slope():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x + 0.5)))).astype(float)
    a, b = training.fit_platt(1 / (1 + np.exp(-x)), y)
    assert a == pytest.approx(2, abs=0.2) and b == pytest.approx(0.5, abs=0.2)


def test_refused_requests_use_nothing_up(spark):
    df = spark.createDataFrame([("r", i, float(a)) for i, a in enumerate([3, 9, 4, 2])], "run string, seq int, amount double")
    assert [r.admitted for r in costs.admit(df, 10.0).orderBy("seq").collect()] == [True, False, True, True]
