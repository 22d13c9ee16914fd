"""Containment, the assembled report, artifacts, training from the command line, sorted files and dataset checks."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_traces import CRM, UPDATED, trace

from tracewright import cli
from tracewright.operators import assembly, dataset, detectors, metrics, report, training
from tracewright.sources import artifacts, recorded, traces


@pytest.mark.parametrize("apart", [False, True])
def test_contained_passages_of_all_lengths(spark, apart):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    bodies = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "one", "\n x  y\n"]
    pieces = ["", "a", "zz", "é", " ", "one", None, "x  y", "\n"]
    for b in bodies[:40]:
        at = rng.randrange(max(1, len(b)))
        pieces.append(b[at : at + rng.choice([1, 3, 8, 9, 15, 40, 90])])
    p = [(k, x, "train" if k % 2 else "test") for k, x in enumerate(pieces)]
    t = [(k, x, "train" if k % 3 else "test") for k, x in enumerate(bodies)]
    got = report.contained(spark.createDataFrame(p, "passage_id int, passage string, side string"), spark.createDataFrame(t, "text_id int, body string, side string"), apart=apart).collect()
    want = sorted((i, j) for i, x, s in p for j, y, o in t if x is not None and y is not None and x in y and (not apart or s != o))
    assert sorted(map(tuple, got)) == want
    assert report.contained(spark.createDataFrame(p[:0], "passage_id int, passage string, side string"), spark.createDataFrame(t, "text_id int, body string, side string")).collect() == []


def predictions(spark, n=300):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        p = rng.choice([0.0, 0.1, 0.5, 0.9, 1.0, rng.random(), None])
        rows.append((rng.choice("ab"), f"t{k}", rng.choice(["train", "test"]), rng.choice(["crm", None]), rng.choice(["none", "wrong_value"]), rng.choice(["probe", "receipt"]), rng.choice([0, 1, 1, None]), p, rng.choice(["verified", "false_success", "unverifiable"]), rng.random() < 0.2))
    return rows, spark.createDataFrame(rows, "detector string, trace_id string, split string, domain string, kind string, evidence string, label int, p double, verdict string, abstain boolean").repartition(3)


def test_report_equals_figures_of_each_part(spark):
    rows, df = predictions(spark)
    flat = {(r.detector, r.cut, r.key): r for r in assembly.flat(assembly.assemble(df)).collect()}
    assert {c for _, c, _ in flat} == {"all", *assembly.CUTS} and ("a", "domain", "") in flat
    for (detector, cut, key), got in flat.items():
        place = {"split": 2, "domain": 3, "kind": 4, "evidence": 5}
        own = [r for r in rows if r[0] == detector and r[6] is not None and (cut == "all" or (r[place[cut]] or "") == key)]
        scored = [r for r in own if r[7] is not None]
        pos, neg = [r[7] for r in scored if r[6] == 1], [r[7] for r in scored if r[6] == 0]
        assert (got.n, got.n_failure) == (len(own), sum(r[6] == 0 for r in own)) and got.caught == sum(r[6] == 0 and r[8] == "false_success" for r in own) and got.abstained == sum(r[9] for r in own)
        assert got.auroc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]), abs=1e-9)
        assert got.brier == pytest.approx(np.mean([(r[7] - r[6]) ** 2 for r in scored]), abs=1e-9)
        bins = np.minimum(np.searchsorted(metrics.ECE_EDGES, [r[7] for r in scored], "right") - 1, 9)
        ece = sum(abs(sum(r[7] - r[6] for r, b in zip(scored, bins, strict=True) if b == k)) for k in range(10)) / len(scored)
        assert got.ece == pytest.approx(ece, abs=1e-9)
    assert assembly.assemble(df.limit(0)).collect() == []
    lines = [json.loads(r.value) for r in assembly.report_lines(assembly.assemble(df)).collect()]
    assert sorted(x["detector"] for x in lines) == ["a", "b"] and list(lines[0]) == sorted(lines[0])


def test_twelve_digits(spark):
    rng = random.Random(0)
    values = [rng.random() * 10 ** rng.randint(-12, 12) for _ in range(500)] + [0.0, 1.0, -0.1 + 0.3, 1e300, 5e-324, -2.5]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(assembly.significant(F.col("v")).alias("x")).collect()]
    assert got == [float(f"{v:.12g}") for v in values]
    assert spark.createDataFrame([(None,)], "v double").select(assembly.significant(F.col("v")).alias("x")).first().x is None


def test_artifacts_are_strict(spark, tmp_path):
    rows = [(f"t{i}", "ab"[i % 2], i % 3 % 2, float(i % 7), float(i % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "trace_id string, domain string, label int, f double, g double").repartition(3)
    model, c, losses, scores = training.train(df, ["f", "g"], (0.1, 1, 10))
    assert c in losses and list(losses) == [0.1, 1.0, 10.0] and scores.count() == 90
    x = np.array([r[3:] for r in rows])
    w, b = training.fit_logistic((x - x.mean(0)) / x.std(0), np.array([r[2] for r in rows]), c)
    assert np.allclose(model.coefficients, w, atol=1e-7) and model.intercept == pytest.approx(b, abs=1e-7) and model.base_rate == pytest.approx(1 / 3) and model.domains == ["a", "b"]
    folder = artifacts.ArtifactFolder(spark, f"file://{tmp_path}/out")
    with pytest.raises(artifacts.ArtifactError, match="missing"):
        folder.model()
    folder.save(folder.MODEL, artifacts.model_object(model, c, losses, 90))
    assert artifacts.differences(folder.model(), model) == [] and folder.chosen_c() == c
    assert artifacts.differences(training.fit(df.repartition(5), ["f", "g"], c), model) == []
    assert artifacts.differences(training.fit(df.where("f != 3"), ["f", "g"], c), model) != []
    with pytest.raises(FileExistsError):
        folder.save(folder.MODEL, {})
    good = artifacts.model_object(model, c, losses, 90)
    for change in ({"format": "pickle"}, {"coef": [1.0]}, {"scales": [1.0, 0.0]}, {"means": [1.0, True]}, {"intercept": float("nan")}, {"base_rate": 2}, {"features": ["f", "f"]}, {"extra": 1}):
        with pytest.raises(artifacts.ArtifactError):
            artifacts.checked_model({**good, **change})
    with pytest.raises(artifacts.ArtifactError):
        artifacts.checked_model({k: v for k, v in good.items() if k != "cv"})
    with pytest.raises(ValueError, match="each outcome needs"):
        training.train(df.where("label = 1"), ["f", "g"])
    found = artifacts.CalibratorSet.fitted(training.fit_calibrators(scores.select(F.lit("lr").alias("detector"), "p", "label", F.lit(False).alias("abstain"))), "rows", 0.5)
    again = artifacts.checked_calibrators(json.loads(json.dumps(found.to_object())))
    assert again == found and again.table(spark).count() == len(found.calibrators)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.checked_calibrators({**found.to_object(), "version": 2})


def test_train_and_report_from_the_command_line(spark, tmp_path, capsys):
    def labelled(k):
        found = trace(f"t{k}", CRM if k % 3 else CRM[:3], [UPDATED])
        return {**found, "ground_truth": {"outcome": "success" if k % 3 else "failure", "checked_by": "human"}}

    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(json.dumps(labelled(k)) for k in range(36)) + "\n" + json.dumps(trace("none", CRM, [UPDATED])))
    assert cli.main(["train", str(path), "--out", f"file://{tmp_path}/model", "--calibrate", "rules"], spark) == 0
    assert "training on 36 traces (skipped 1 unlabelled, 0 without a success claim)" in capsys.readouterr().out
    folder = artifacts.ArtifactFolder(spark, f"file://{tmp_path}/model")
    assert folder.model().base_rate == pytest.approx(2 / 3) and folder.calibrators().fitted_on == str(path)
    assert cli.main(["train", str(path), "--out", f"file://{tmp_path}/model"], spark) == 2  # never over another
    assert cli.main(["train", str(path), "--out", f"file://{tmp_path}/m2", "--calibrate", "oracle"], spark) == 2
    path.write_text(json.dumps(labelled(1)))
    assert cli.main(["train", str(path), "--out", f"file://{tmp_path}/m3"], spark) == 2
    run = recorded.RunFolder(spark, f"file://{tmp_path}/run")
    rows = [("rules", f"t{k}", "test" if k % 2 else "train", "crm", "success" if k % 3 else "failure", k / 20, False) for k in range(20)]
    run.write("offline-predictions.jsonl", spark.createDataFrame(rows, "detector string, trace_id string, split string, domain string, outcome string, p_raw double, abstain boolean"))
    capsys.readouterr()
    assert cli.main(["report", f"file://{tmp_path}/run"], spark) == 0
    line = capsys.readouterr().out.splitlines()[2]
    assert line.startswith("| rules | 10 | 3 | ")


def test_sorted_files(spark, tmp_path):
    ids = [f"t{k * 37 % 101:03d}" for k in range(101)]
    raw = spark.createDataFrame([(k, json.dumps({**trace(i, CRM, [UPDATED]), "meta": None, "ground_truth": None})) for k, i in enumerate(ids)], "line_no long, value string").repartition(4)
    lines = traces.trace_lines(traces.validate(raw).lines)
    traces.write_sorted(lines, f"file://{tmp_path}/sorted")
    text = "".join(f.read_text() for f in sorted((tmp_path / "sorted").glob("part-*"))).splitlines()
    found = [json.loads(x) for x in text]
    assert [x["trace_id"] for x in found] == sorted(ids) and all("meta" not in x and "ground_truth" not in x for x in found)
    assert all(list(x) == sorted(x) for x in found) and found[0]["steps"] == trace("t000", CRM, [UPDATED])["steps"]
    with pytest.raises(FileExistsError):
        traces.write_sorted(lines, f"file://{tmp_path}/sorted")
    for bad in (lines.withColumn("value", F.lit("{cut")), lines.unionByName(lines.limit(1))):
        with pytest.raises(traces.TraceLineError):
            traces.write_sorted(bad, f"file://{tmp_path}/other")
        assert sorted(p.name for p in tmp_path.iterdir()) == ["sorted"]


def test_judged_cascade_asks_only_about_the_rest(spark):
    rules = spark.createDataFrame([("a", 0.97, False, 1.0), ("b", 0.70, False, 2.0), ("c", 0.5, True, 3.0), ("d", 0.03, False, 4.0), ("e", 0.97, True, 5.0)], "trace_id string, p double, abstain boolean, latency_ms double")
    asked = []

    def judge(left):
        asked.extend(r.trace_id for r in left.collect())
        return left.where("trace_id != 'e'").select("trace_id", F.lit(0.4).alias("p"), F.lit(False).alias("abstain"), F.lit(None).cast("string").alias("abstain_reason"), F.lit(100.0).alias("latency_ms"))

    got = {r.trace_id: r for r in detectors.judged_cascade(rules.select("trace_id"), rules, judge).collect()}
    assert sorted(asked) == ["b", "c", "e"] and {k: r.decided_by for k, r in got.items()} == {"a": "rules", "b": "judge", "c": "judge", "d": "rules", "e": "judge"}
    assert got["b"].latency_ms == 102.0 and got["a"].latency_ms == 1.0 and got["e"].abstain and got["e"].abstain_reason == "judge_missing" and got["c"].p == 0.4


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c"]), rng.choice([1.0, 2.0, 2.0, rng.random() * 9, None])) for _ in range(400)] + [("d", 7.0)]
    got = {r.g: (r.q0, r.q1, r.q2) for r in metrics.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.5, 0.95)).collect()}
    for g in "abcd":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], [0, 0.5, 0.95]))


def test_file_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "a.jsonl").write_bytes(b"one\n")
    (tmp_path / "b.jsonl").write_bytes(b"")
    found = dataset.file_digests(spark, f"file://{tmp_path}")
    assert {r.name: (r.bytes, r.sha256) for r in found.collect()} == {"a.jsonl": (4, hashlib.sha256(b"one\n").hexdigest())}  # Spark doesn't read empty files
    manifest = spark.createDataFrame([("a.jsonl", "0"), ("c.jsonl", "1")], "name string, sha256 string")
    assert {r.name for r in dataset.digest_differences(found.select("name", "sha256"), manifest).collect()} == {"a.jsonl", "c.jsonl"}
