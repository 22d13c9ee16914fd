"""Loading, rules, claims and features on traces written by hand."""

import json

import pytest

from tracewright.operators import claims as claim_ops
from tracewright.operators import detectors, rules
from tracewright.operators.steps import call_results, features, merge_probes, pair_results
from tracewright.sources.packs import PackError, builtin_packs, parse_pack
from tracewright.sources.traces import TraceLineError, detector_view, load_probes, load_traces


def step(i, kind, role, **more):
    return {"i": i, "ts": "2026-01-01T00:00:00Z", "kind": kind, "role": role, **more}


def trace(name, steps, claims=(), text="Done.", domain="crm", **more):
    return {"schema": "agent-trace/v1", "trace_id": name, "source": "test", "task": {"id": "t", "domain": domain, "instruction": "Set the phone of r1 to 12."}, "steps": steps, "final_claim": {"text": text, "claims": list(claims)}, **more}


CRM = [
    step(0, "message", "user", content="hi"),
    step(1, "tool_call", "agent", name="crm.get_contact", args={"record_id": "r1"}),
    step(2, "tool_result", "tool", name="crm.get_contact", ok=True, output={"record_id": "r1"}),
    step(3, "tool_call", "agent", name="crm.update_contact", args={"record_id": "r1", "phone": 12}),
    step(4, "tool_result", "tool", name="crm.update_contact", ok=False, error={"code": 409}),
    step(5, "tool_call", "agent", name="crm.update_contact", args={"record_id": "r1", "phone": 12}),
    step(6, "tool_result", "tool", name="crm.update_contact", ok=True, output={"record_id": "r1", "status": "accepted"}, error=None),
]
UPDATED = {"type": "updated", "subject": {"record_id": " R1", "fields": {"phone": 12}}}


@pytest.fixture
def load(spark, tmp_path):
    def run(lines, **more):
        path = tmp_path / "traces.jsonl"
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        return load_traces(spark, str(path), **more)

    return run


def outcome(load, *traces):
    loaded = load(traces)
    got = rules.evaluate_claims(loaded.claims(), loaded.steps(), loaded.traces(), builtin_packs())
    return {(r.trace_id, r.type): (r.outcome, r.step) for r in got.collect()}


def test_errors_have_lines_and_paths(load):
    good = trace("a", CRM)
    loaded = load([good, "", "{broken", trace("a", CRM), trace("b", [CRM[1], CRM[0]]), {**good, "extra": 1}, {**trace("c", CRM), "task": {"id": "x", "domain": "music", "instruction": "y"}}])
    assert {(r.line_no, r.json_path) for r in loaded.errors.collect()} == {(3, "$"), (4, "$.trace_id"), (5, "$.steps"), (6, "$"), (7, "$.task.domain")}
    assert [r.trace_id for r in loaded.traces().collect()] == ["a"]
    with pytest.raises(TraceLineError, match="line 3"):
        load([good, "", "{broken"], strict=True)


def test_errors_of_a_folder_name_the_file(spark, tmp_path):
    for name, lines in (("a", [trace("x", CRM)]), ("b", [trace("x", CRM), trace("y", CRM)])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    loaded = load_traces(spark, str(tmp_path))
    (error,) = loaded.errors.collect()
    assert error.file.endswith("/b.jsonl") and (error.line_no, error.json_path) == (1, "$.trace_id") and error.message.endswith("/a.jsonl")
    assert sorted(r.trace_id for r in loaded.traces().collect()) == ["x", "y"]


def test_empty_file(load):
    loaded = load([""])
    assert loaded.traces().count() == 0 and loaded.errors.count() == 0 and loaded.steps().count() == 0


def test_view_has_no_labels(load):
    loaded = load([trace("a", CRM, ground_truth={"outcome": "success", "checked_by": "human", "details": {"note": "canary"}}, meta={"x": "canary"})])
    assert "canary" not in str(detector_view(loaded.traces()).collect())


def test_pairing(load):
    steps = load([trace("a", [*CRM, step(7, "tool_result", "tool", name="crm.other", ok=True), step(8, "tool_result", "tool", name="crm.update_contact", ok=False)])]).steps()
    assert {r.i: r.call_i for r in pair_results(steps).collect() if r.kind == "tool_result"} == {2: 1, 4: 3, 6: 5, 7: None, 8: 5}
    assert {r.call_i: r.result_i for r in call_results(steps).collect()} == {1: 2, 3: 4, 5: 8}


def test_outcomes(load):
    probe = lambda fields, **more: step(7, "state_probe", "environment", name="crm.read_record", ok=True, output={"fields": fields}, **more)
    got = outcome(
        load,
        trace("receipt", CRM, [UPDATED]),
        trace("probe", [*CRM, probe({"phone": 12.0, "x": 1})], [UPDATED]),
        trace("denied", [*CRM, probe({"phone": 13})], [UPDATED]),
        trace("failed", CRM[:5], [UPDATED]),
        trace("none", CRM[:3], [UPDATED]),
        trace("other", CRM, [{"type": "danced", "subject": {}}]),
        trace("wrong", CRM, [{"type": "updated", "subject": {"record_id": "r2"}}]),
        trace("no_subject", [*CRM, probe({})], [{"type": "updated", "subject": {}}]),
    )
    assert {k[0]: v for k, v in got.items()} == {
        "receipt": ("receipt_only", 6), "probe": ("probe_supported", 7), "denied": ("contradicted", 7), "failed": ("contradicted", 4), "none": ("unsupported", None),
        "other": ("unknown", None), "wrong": ("contradicted", 6), "no_subject": ("receipt_only", 6),
    }


def test_booking_compares_moments(load):
    args = {"start": "2026-04-06T15:00:00+02:00", "duration_min": "30"}
    steps = [step(0, "tool_call", "agent", name="calendar.create_event", args=args), step(1, "tool_result", "tool", name="calendar.create_event", ok=True, output={"event_id": "e", "start": "2026-04-06T13:00:00Z", "attendees": ["A@x.test "]})]
    claim = {"type": "booked", "subject": {"start": "2026-04-06T15:00:00+02:00", "duration_min": 30, "attendee_email": "a@X.test"}}
    assert outcome(load, trace("b", steps, [claim], domain="booking"))[("b", "booked")] == ("receipt_only", 1)


def test_worst_claim_and_results(load):
    loaded = load([trace("a", CRM, [UPDATED, {"type": "danced", "subject": {}}]), trace("b", CRM, [{"type": "failed", "subject": {}}])])
    scored = detectors.rules(loaded.traces(), loaded.steps(), claim_ops.success_claims(loaded.claims()), builtin_packs())
    got = {r.trace_id: (r.verdict, r.abstain_reason) for r in detectors.results(loaded.traces(), scored, claim_ops.success_claims(loaded.claims())).collect()}
    assert got == {"a": ("unverifiable", "no_rule"), "b": ("skipped", "no_success_claim")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Scheduled the call. Confirmed.", [("booked", 0, 9)]),
        ("I couldn't get it booked.", []),
        ("It wasn’t booked. All set.", [("done", 18, 25)]),
        ("Booked it, not yet confirmed.", []),
        ("This is done.", [("done", 8, 12)]),
        ("", []),
    ],
)
def test_extraction(load, text, want):
    loaded = load([trace("a", [], text=text, domain="booking")])
    got = claim_ops.extract_claims(loaded.traces(), loaded.steps(), builtin_packs())
    assert [(r.type, r.start, r.end) for r in got.orderBy("claim_idx").collect()] == want


def test_features(load):
    loaded = load([trace("a", CRM, [UPDATED], text="It looks like 12 is set to 99.")])
    f = features(loaded.steps(), loaded.traces(), loaded.claims()).first()
    assert (f.n_steps, f.n_write_calls, f.n_read_calls, f.write_success_ratio, f.n_retries) == (7, 2, 1, 0.5, 1)
    assert f.failed_result_share == pytest.approx(1 / 3) and f.pending_status_present == 1 and f.receipt_id_present == 1 and f.hedge_words_present == 1
    assert f.unsupported_value_ratio == 1 and f.instruction_value_coverage == 1 and f.last_write_succeeded == 1


def test_probe_merge(spark, load, tmp_path):
    path = tmp_path / "probes.jsonl"
    lines = [{"trace_id": "a", "name": "crm.read_record", "ok": True, "ts": "2026-01-01T00:00:00Z", "output": {"fields": {}}}, {"trace_id": "zz", "name": "p", "ok": None, "ts": "2026-01-01T00:00:00Z"}]
    path.write_text("\n".join(map(json.dumps, lines)))
    loaded = load([trace("a", CRM)])
    merged, unknown = merge_probes(loaded.steps(), load_probes(spark, str(path)), loaded.traces())
    assert merged.where("kind = 'state_probe'").first().i == 7 and [r.trace_id for r in unknown.collect()] == ["zz"]
    path.write_text('{"trace_id": "a"}')
    with pytest.raises(Exception, match="invalid probe in line 1"):
        load_probes(spark, str(path)).collect()


@pytest.mark.parametrize("text", ["pack: x", "pack: x\nversion: 1\nother: 2", "pack: x\nversion: 1\nclaims: {a: {action: b, receipt: {c: {equals: 1, exists: true}}}}", "pack: x\nversion: 1\nclaim_patterns: {a: ['(']}", "!!python/object:os.system {}"])
def test_bad_packs(text):
    with pytest.raises(PackError):
        parse_pack(text)
