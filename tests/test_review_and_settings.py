"""The reviewer's view and decisions, prompt files, settings, and the stream that records errors."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_traces import CRM, UPDATED, trace

from tracewright.operators import review
from tracewright.sources import prompts, settings, traces
from tracewright.sources.packs import builtin_packs
from tracewright.streaming import audit


def loaded(spark, *found):
    return traces.validate(spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(found)], "line_no long, value string"))


def test_payload_has_all_but_labels(spark):
    one = {**trace("a", CRM, [UPDATED]), "ground_truth": {"outcome": "failure", "checked_by": "human"}, "meta": {"secret": 1}}
    two = loaded(spark, one, trace("b", CRM[:1]), trace("c", CRM))
    results = spark.createDataFrame([("a", "unverifiable", 0.5), ("b", "skipped", None)], "trace_id string, verdict string, p_success double")
    judged = spark.createDataFrame([("a", 0.4, "none", "why", [1], False, False), ("b", None, None, None, None, None, True)], "trace_id string, p double, failure_kind string, rationale string, evidence_steps array<long>, invalid_citation boolean, abstain boolean")
    outcomes = spark.createDataFrame([("a", 0, "crm.updated", "receipt_only", 2)], "trace_id string, claim_idx int, rule string, outcome string, step int")
    got = {r.trace_id: r for r in review.payload(two.traces(), two.steps(), two.claims(), results, outcomes, judged).collect()}
    assert sorted(got) == ["a", "b"] and [s.i for s in got["a"].steps] == [s["i"] for s in one["steps"]] and got["a"].judge.rationale == "why" and got["b"].judge is None
    assert [(c.type, json.loads(c.subject)) for c in got["a"].claims] == [(UPDATED["type"], UPDATED["subject"])] and got["b"].claims == [] and got["b"].rule_evidence == [] and got["a"].rule_evidence[0].outcome == "receipt_only"
    assert "secret" not in str(got["a"]) and "human" not in str(got["a"])


def test_reviews_are_added_once_and_checked(spark, tmp_path):
    old = {**trace("a", CRM, [UPDATED]), "ground_truth": {"outcome": "unknown", "checked_by": "none"}, "meta": None}
    lines = loaded(spark, old, trace("b", CRM), trace("c", CRM)).lines
    decisions = spark.createDataFrame([("a", "verified", 'a "quoted" note', "unverifiable", "2026-01-01T00:00:00Z"), ("b", "false_success", None, "unverifiable", "2026-01-01T00:00:00Z")], "trace_id string, decision string, note string, previous_verdict string, reviewed_at string")
    path = f"file://{tmp_path}/reviews"
    assert review.append_reviews(lines, decisions, path, 0) and not review.append_reviews(lines, decisions, path, 0)
    found = {x["trace_id"]: x for f in (tmp_path / "reviews").glob("batch=*/part-*") for x in map(json.loads, f.read_text().splitlines())}
    assert sorted(found) == ["a", "b"] and found["a"]["ground_truth"] == {"checked_by": "human", "outcome": "success", "details": {"decision": "verified", "note": 'a "quoted" note', "previous_verdict": "unverifiable", "reviewed_at": "2026-01-01T00:00:00Z"}}
    assert found["b"]["ground_truth"]["outcome"] == "failure" and "meta" not in found["a"] and found["a"]["steps"] == old["steps"]
    again = traces.load_traces(spark, f"{path}/batch=*")
    assert again.errors.count() == 0 and {(r.trace_id, r.gt_outcome) for r in again.traces().collect()} == {("a", "success"), ("b", "failure")}
    with pytest.raises(Exception, match="no such decision"):
        review.append_reviews(lines, decisions.withColumn("decision", F.lit("maybe")), path, 1)
    assert [p.name for p in (tmp_path / "reviews").iterdir()] == ["batch=00000000000000000000"]


def test_prompts(spark, tmp_path):
    raw = "---\nname: audit\nversion: 2\n---\nAudit the clåims.\n---\nnot a header\n"
    p = prompts.parse_prompt(raw)
    assert (p.name, p.version, p.text) == ("audit", 2, "Audit the clåims.\n---\nnot a header\n") and p.sha256 == hashlib.sha256(raw.encode()).hexdigest()
    for bad in ("no header", "---\nname: a\n---\nx", "---\nversion: 1\n---\nx", "---\nname: a\nversion: true\n---\nx", "---\n- a\n---\nx", "---\nname: [\n---\nx"):
        with pytest.raises(prompts.PromptError):
            prompts.parse_prompt(bad)
    (tmp_path / "a.md").write_text(raw)
    (tmp_path / "b.md").write_text(raw.replace("audit", "brief"))
    found = prompts.load_prompts(spark, f"file://{tmp_path}")
    assert [x.name for x in found] == ["audit", "brief"] and found[0] == p and prompts.prompt_table(spark, found).where("version = 2").count() == 2
    (tmp_path / "c.md").write_text(raw)
    with pytest.raises(prompts.PromptError, match="several"):
        prompts.load_prompts(spark, f"file://{tmp_path}")


def test_settings(tmp_path):
    file = tmp_path / "s.toml"
    file.write_text('[gate]\nverified = 0.9\n[judge]\nmodel = "file"\nin_flight = 2\n[budget]\nmax_usd = 3\n[rules]\npacks = ["a.yaml"]\n')
    env = {"TRACEWRIGHT_MODEL": "env", "TRACEWRIGHT_MAX_USD": "4.5", "TRACEWRIGHT_LEDGER": ""}
    plain = settings.load_settings(environment={})
    assert plain["gate.verified"] == 0.8 and plain["budget.max_usd"] == 1.0 and plain["judge.model"] is None
    got = settings.load_settings(str(file), {"judge.model": "given", "judge.in_flight": None}, env)
    assert (got["judge.model"], got["budget.max_usd"], got["judge.in_flight"], got["rules.packs"], got["budget.ledger"]) == ("given", 4.5, 2, ("a.yaml",), None)
    assert settings.load_settings(str(file), {}, {})["budget.max_usd"] == 3.0 and settings.thresholds(got).verified == 0.9
    for bad in ({"judge.max_tokens": "9"}, {"gate.verified": True}, {"what": 1}):
        with pytest.raises(settings.SettingsError):
            settings.load_settings(None, bad, {})
    with pytest.raises(settings.SettingsError):
        settings.load_settings(None, {}, {"TRACEWRIGHT_MAX_USD": "much"})
    with pytest.raises(settings.SettingsError):
        settings.load_settings(str(tmp_path / "none.toml"))


def test_stream_of_results_and_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join([json.dumps(trace("a", CRM, [UPDATED])), "{broken", "", json.dumps(trace("b", CRM[:3], [UPDATED])), json.dumps({**trace("c", CRM), "source": 7})]))
    run = lambda state: audit.audit_stream(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", str(tmp_path / state), builtin_packs()).awaitTermination(180)
    run("state")
    (tmp_path / "in" / "2.jsonl").write_text(json.dumps(trace("d", CRM, [UPDATED])))
    run("state")
    read = lambda name: spark.read.parquet(f"file://{tmp_path}/out/{name}")
    assert {(r.trace_id, r.verdict) for r in read("results").collect()} == {("a", "unverifiable"), ("b", "false_success"), ("d", "unverifiable")}
    assert sorted((r.line_no, r.json_path, r.file.rpartition("/")[2]) for r in read("errors").collect()) == [(2, "$", "1.jsonl"), (5, "$.source", "1.jsonl")]
    run("other")  # all files in one batch, whose number is there already
    assert read("results").count() == 3
