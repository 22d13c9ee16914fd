"""Transport with retries, the judge's cache, its runs, and recorded runs."""

import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracewright.operators import judge, transport
from tracewright.operators.transport import Policy, Reply, Timeout, Unreachable, Waits, complete
from tracewright.sources import recorded
from tracewright.sources.judge_cache import JudgeCache, cache_key
from tracewright.streaming.judge_run import AlreadyRunning, JudgeRun

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this module


def said(content, **more):
    return Reply(200, json.dumps({"choices": [{"message": {"content": content}}], **more}))


class Script:
    """A transport that gives its replies in turn."""

    def __init__(self, *replies):
        self.replies, self.calls = list(replies), 0

    def __call__(self, request):
        self.calls += 1
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def run(*replies, policy=Policy()):
    waits = Waits()
    out = complete(Script(*replies), "{}", policy, waits.sleep, waits.clock)
    return out.content, out.failure, out.attempts, waits.now


@pytest.mark.parametrize(
    ("replies", "want"),
    [
        ([said("a", usage={"cost": 1})], ("a", None, 1, 0.0)),
        ([Reply(429), said("a")], ("a", None, 2, 0.5)),
        ([Reply(429), Reply(429), Reply(429)], (None, "http_429", 3, 1.5)),
        ([Reply(429, retry_after="3"), Reply(503, retry_after="0"), said("a")], ("a", None, 3, 3.0)),
        ([Reply(429, retry_after="3600"), said("a")], ("a", None, 2, 10.0)),
        ([Reply(429, retry_after="soon"), Reply(429, retry_after="-1"), said("a")], ("a", None, 3, 1.5)),
        ([Reply(429, retry_after="nan"), Reply(429, retry_after="inf"), said("a")], ("a", None, 3, 1.5)),
        ([Reply(500), Reply(502), Reply(599)], (None, "http_5xx", 3, 1.5)),
        ([Reply(404)], (None, "http_4xx", 1, 0.0)),
        ([Timeout(), Timeout(), Timeout()], (None, "timeout", 3, 1.5)),
        ([Unreachable(), said("a")], ("a", None, 2, 0.5)),
        ([Unreachable(), Timeout(), Unreachable()], (None, "network", 3, 1.5)),
        ([Reply(200, "no json")], (None, "invalid_response", 1, 0.0)),
        ([Reply(200, '{"choices": []}')], (None, "invalid_response", 1, 0.0)),
        ([Reply(200, "[]")], (None, "invalid_response", 1, 0.0)),
        ([said(7)], (None, "invalid_response", 1, 0.0)),
    ],
)
def test_retries_and_failures(replies, want):
    assert run(*replies) == want


def test_usage_is_an_object():
    assert complete(Script(said("a", usage={"b": 1, "a": 2})), "").usage == '{"a": 2, "b": 1}' and complete(Script(said("a", usage=[1])), "").usage == "{}"


def test_other_errors_are_not_swallowed():
    with pytest.raises(ZeroDivisionError):
        complete(Script(ZeroDivisionError()), "")


def test_calls_are_in_flight_side_by_side_and_keep_their_order(spark):
    def connect():
        lock, now, most = threading.Lock(), [0], [0]

        def send(request):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.02 if int(request) % 3 else 0.05)
            with lock:
                now[0] -= 1
            return said(f"{request}:{most[0]}")

        return send

    df = spark.range(60).select("id", F.col("id").cast("string").alias("request")).coalesce(1)
    got = [r.content.split(":") for r in transport.call_all(df, connect, Policy(in_flight=5)).collect()]
    assert [int(a) for a, _ in got] == list(range(60)) and 2 <= max(int(b) for _, b in got) <= 5


def answering():
    return lambda request: said(f"re {request}", usage={"cost": 0.5}) if "bad" not in request else Reply(404)


def refusing():
    def send(request):
        raise AssertionError("nobody may be asked")

    return send


def test_judge_asks_once(spark, tmp_path):
    cache = JudgeCache(spark, f"file://{tmp_path}/cache")
    key = cache_key(F.lit("m"), F.lit(1), F.col("request"))
    requests = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t3", "a"), ("t4", "bad")], "trace_id string, request string").withColumn("cache_key", key)
    got = {r.trace_id: (r.content, r.failure, r.cached, r.attempts) for r in judge.ask(requests, cache, answering).collect()}
    assert got == {"t1": ("re a", None, False, 1), "t2": ("re b", None, False, 1), "t3": ("re a", None, False, 1), "t4": (None, "http_4xx", False, 1)}
    assert cache.read().count() == 2  # a failure is not kept
    good = requests.where("trace_id != 't4'")
    assert {(r.trace_id, r.content, r.usage, r.cached) for r in judge.ask(good, cache, refusing).collect()} == {(t, f"re {x}", '{"cost": 0.5}', True) for t, x in (("t1", "a"), ("t2", "b"), ("t3", "a"))}
    assert len(cache.folder.names("segment=")) == 1  # nothing new, no segment


def test_cache_keeps_first_answers_and_drops_broken_rows(spark, tmp_path):
    cache = JudgeCache(spark, f"file://{tmp_path}/cache")
    answers = lambda *rows: spark.createDataFrame(rows, "cache_key string, content string, usage string")
    assert cache.read().collect() == [] and cache.merge(answers(("k1", "a", '{"x": 1}'), ("k2", "b", None), ("k1", "z", "{}"), (None, "x", None), ("k3", None, None))) == 2
    assert cache.merge(answers(("k1", "other", "{}"), ("k4", "d", "no json"))) == 1
    rows = lambda: {r.cache_key: (r.content, r.usage) for r in cache.read().collect()}
    assert rows() == {"k1": ("a", '{"x": 1}'), "k2": ("b", "{}"), "k4": ("d", "{}")}
    broken = cache.rows().where("cache_key = 'k2'").withColumn("content", F.lit("forged"))
    broken.write.parquet(str(tmp_path / "cache" / "segment=000000000009"))
    cache.rows().where("cache_key = 'k1'").withColumn("cache_key", F.lit("k5")).write.parquet(str(tmp_path / "cache" / "segment=000000000010"))
    assert "k5" not in rows() and rows()["k2"] == ("b", "{}")
    assert cache.merge(answers(("k5", "e", "{}"))) == 1 and rows()["k5"] == ("e", "{}")  # a broken row is a miss
    before = rows()
    cache.compact()
    assert rows() == before and cache.folder.names("segment=") == [] and cache.rows().count() == len(before)
    assert cache.merge(answers(("k1", "late", "{}"), ("k6", "f", "{}"))) == 1 and rows() == before | {"k6": ("f", "{}")}


def test_two_writers_of_a_cache(spark, tmp_path):
    """The one that comes second looks again at what is new."""
    one, two = (JudgeCache(spark, f"file://{tmp_path}/cache") for _ in range(2))
    answers = lambda *rows: spark.createDataFrame(rows, "cache_key string, content string")
    seen = two._parts()
    calls = iter([seen, seen])
    plain = two._parts
    two._parts = lambda: next(calls, None) or plain()
    one.merge(answers(("k1", "a")))
    assert two.merge(answers(("k1", "b"), ("k2", "c"))) == 1
    assert {r.cache_key: r.content for r in one.read().collect()} == {"k1": "a", "k2": "c"} and one.rows().count() == 2


def scoring(df):
    n = F.substring("trace_id", 2, 9).cast("int")
    return df.select("trace_id", F.lit("verified").alias("verdict"), (n / 100).alias("p_success"), F.lit(0.25).alias("cost_usd"), F.when(n % 10 == 0, "timeout").alias("error"))


def test_judge_run_goes_on_where_it_stopped(spark, tmp_path):
    path, queue = f"file://{tmp_path}/run", spark.range(50).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("trace_id"))
    run = JudgeRun(spark, path, scoring)
    with pytest.raises(LookupError):
        run.snapshot()
    assert run.start(queue.union(queue.limit(3)), chunk=8)["total"] == 50
    with pytest.raises(AlreadyRunning):
        run.start(queue)
    part = run.go(2)
    assert (part["status"], part["done"]) == ("running", 16)
    asked = []

    def crashing(df):
        asked.append(df.count())
        if len(asked) == 2:
            raise RuntimeError
        return scoring(df)

    whole = JudgeRun(spark, path, crashing).go()
    assert (whole["status"], whole["done"], whole["total"]) == ("completed", 50, 50) and sum(asked) == 34
    rows = run.results().collect()
    assert sorted(r.trace_id for r in rows) == sorted(f"t{k}" for k in range(50))
    assert sum(r.error == "worker_error" for r in rows) == 8 and whole["spent_usd"] == 0.25 * 42


def test_judge_run_is_cancelled(spark, tmp_path):
    queue = spark.range(20).select(F.col("id").cast("string").alias("trace_id"))
    run = JudgeRun(spark, f"file://{tmp_path}/run", lambda df: (run.cancel(), scoring(df))[1])
    run.start(queue, chunk=5)
    got = run.go()
    assert (got["status"], got["done"]) == ("cancelled", 5) and run.go()["done"] == 5
    empty = JudgeRun(spark, f"file://{tmp_path}/none", scoring)
    assert empty.start(queue.limit(0))["total"] == 0 and empty.go()["status"] == "completed"


def test_recorded_run(spark, tmp_path):
    run = recorded.RunFolder(spark, f"file://{tmp_path}/run")
    none = run.read()
    assert none.meta == {} and none.calibration == {} and none.predictions.count() == none.timings.count() == none.judge_records.count() == 0
    p = spark.createDataFrame([("rules", "té", 0.25, None), ("rules", "t2", None, True)], "detector string, trace_id string, p_raw double, abstain boolean")
    run.write("offline-predictions.jsonl", p)
    run.write_object("run.json", {"b": 1, "a": "é"})
    with pytest.raises(FileExistsError):
        run.write("offline-predictions.jsonl", p)
    with pytest.raises(FileExistsError):
        run.write_object("run.json", {})
    got = run.read()
    assert got.meta == {"a": "é", "b": 1} and {(r.trace_id, r.p_raw, r.abstain, r.domain) for r in got.predictions.collect()} == {("té", 0.25, None, None), ("t2", None, True, None)}
    assert json.loads(recorded.json_lines(p).first().value) == {"abstain": None, "detector": "rules", "p_raw": 0.25, "trace_id": "té"}
    (tmp_path / "run" / "judge-records.jsonl").write_text('{"detector": "j"}\n{"detector": "cut')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        run.read().judge_records.collect()
