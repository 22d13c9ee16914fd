"""Live runs under a budget."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracewright.operators import live
from tracewright.operators.transport import Reply
from tracewright.sources.judge_cache import JudgeCache, cache_key
from tracewright.streaming import ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this module

ANSWER = {"p_success": 0.5, "failure_kind": "none", "evidence_steps": [9], "rationale": "r"}


def server():
    def send(request):
        if request.startswith("bad"):
            return Reply(500)
        usage = {"cost": 0.25} if request.startswith("dear") else {"prompt_tokens": 1000, "completion_tokens": 500}
        return Reply(200, json.dumps({"choices": [{"message": {"content": json.dumps(ANSWER)}}], "usage": usage}))

    return send


def refusing():
    def send(request):
        raise AssertionError("nobody may be asked")

    return send


def requests(spark, *said):
    df = spark.createDataFrame([(f"t{k}", x, m) for k, (x, m) in enumerate(said)], "trace_id string, request string, model string")
    return df.select("trace_id", F.lit("test").alias("split"), F.concat(F.lit("judge:"), "model").alias("detector"), "model", F.lit("p").alias("prompt_name"), "request", cache_key(F.col("model"), F.lit(1), F.col("request")).alias("cache_key"), F.lit(1000).alias("max_tokens"))


def test_rounds_under_a_budget(spark, tmp_path):
    cache, path = JudgeCache(spark, f"file://{tmp_path}/cache"), f"file://{tmp_path}/ledger"
    prices = spark.createDataFrame([("m", 0.0, 1000.0)], "model string, price_in double, price_out double")
    # A call may cost 1.1 and costs 0.5 (a tenth of a cent for none of the input) or 0.25: under 2.5 two go out at a time.
    asked = requests(spark, ("a", "m"), ("b", "m"), ("dear", "m"), ("a", "m"), ("bad", "m"), ("c", "m"), ("d", "m"), ("e", "m"), ("free?", "x"))
    planned = live.plan(asked, prices, cache)
    before = live.preflight(planned).where("detector = 'judge:m'").first()
    assert (before.n_calls, before.n_cached, round(before.reserved_usd, 6)) == (8, 0, 8.8)
    got = {r.trace_id: r for r in live.run(planned, cache, server, "run", path, 2.5, real=False).collect()}
    assert len(got) == 9 and got["t8"].failure == "unknown_price" and got["t4"].failure == "http_5xx" and got["t4"].cost_usd == 0
    assert [round(got[f"t{k}"].cost_usd, 6) for k in (0, 1, 2, 3, 5)] == [0.5, 0.5, 0.25, 0.0, 0.5] and got["t3"].cached and not got["t0"].cached
    spent = sum(r.cost_usd for r in got.values())
    assert spent <= 2.5 and [got[f"t{k}"].failure for k in (5, 6, 7)] == [None, "budget_exhausted", "budget_exhausted"]
    totals = {r.run_id: r for r in ledger.totals(ledger.read(spark, path)).collect()}
    assert totals["run"].calls == 9 and round(totals["run"].spent_usd, 6) == round(spent, 6) and totals["run"].exhausted
    made = [r.cache_key for r in got.values() if r.failure is None]
    again = live.plan(asked.where(F.col("cache_key").isin(made)), prices, cache)
    assert live.preflight(again).first().reserved_usd == 0 and {r.cost_usd for r in live.run(again, cache, refusing, "run", f"{path}-2", 0.0, real=False).collect()} == {0.0}


def test_equal_requests_of_a_round_are_paid_once(spark, tmp_path):
    cache = JudgeCache(spark, f"file://{tmp_path}/cache")
    prices = spark.createDataFrame([("m", 0.0, 1000.0)], "model string, price_in double, price_out double")
    answers = live.run(live.plan(requests(spark, ("a", "m"), ("a", "m"), ("a", "m")), prices, cache), cache, server, "run", f"file://{tmp_path}/ledger", 100.0, real=False)
    assert sorted(r.cost_usd for r in answers.collect()) == [0.0, 0.0, 0.5]
    steps = spark.createDataFrame([("t0", [9]), ("t1", [1])], "trace_id string, steps array<bigint>")
    prompts = spark.createDataFrame([("p", "text")], "prompt_name string, prompt string")
    got = {r.trace_id: (r.p_raw, r.abstain, r.detector) for r in live.records(answers, steps, prompts).collect()}
    assert got == {f"t{k}": (0.5, False, "judge:m") for k in range(3)}
    assert live.run(live.plan(requests(spark, ("a", "m")).limit(0), prices, cache), cache, refusing, "run", f"file://{tmp_path}/none", 1.0).collect() == []
