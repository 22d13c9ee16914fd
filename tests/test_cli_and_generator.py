"""The command line's exit codes, and what the rules make of generated traces."""

import json

from test_traces import CRM, UPDATED, trace

from tracewright import cli
from tracewright.operators import rules
from tracewright.sources import generator
from tracewright.sources.packs import builtin_packs


def test_exit_codes(spark, tmp_path, capsys):
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps(trace("a", CRM, [UPDATED])))
    assert cli.main(["check", str(path)], spark) == 0 and "unverifiable: 1" in capsys.readouterr().out
    path.write_text(json.dumps(trace("a", CRM[:3], [UPDATED])))
    assert cli.main(["check", str(path), "--out", str(tmp_path / "out")], spark) == 1
    assert cli.main(["check", str(path), "--fail-on", "skipped"], spark) == 0
    assert cli.main(["check", str(path), "--fail-on", "nonsense"], spark) == 2
    assert cli.main(["validate", str(path)], spark) == 0
    path.write_text("{broken")
    assert cli.main(["validate", str(path)], spark) == 2 and cli.main(["check", str(path), "--strict"], spark) == 2


def test_generated_traces(spark):
    made = generator.generate(spark, 300).cache()
    assert sorted(map(str, made.collect())) == sorted(map(str, generator.generate(spark, 300, partitions=3).collect()))
    traces, steps, claims = generator.as_tables(made)
    got = rules.worst_outcomes(rules.evaluate_claims(claims, steps, traces, builtin_packs())).join(made.select("trace_id", "kind", "evidence", "domain", "label"), "trace_id").collect()
    assert len(got) == 300
    for r in got:
        if r.kind == "phantom_action":
            assert r.outcome == "unsupported"
        if r.kind == "error_ignored" or (r.kind == "wrong_target" and r.domain == "crm"):
            assert r.outcome == "contradicted"
        if r.label == 1:
            assert r.outcome == ("receipt_only" if r.evidence == "receipt_only" else "probe_supported")
