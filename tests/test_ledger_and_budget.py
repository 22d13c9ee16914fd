"""The ledger's batches, exact ranks, and budgets as state."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import budget, ranks
from tracewright.sources import folders
from tracewright.streaming import ledger


def entries(spark, rows):
    return spark.createDataFrame(rows, "run_id string, trace_id string, actual_usd double, cached boolean, status string")


def spent(spark, path):
    return {r.run_id: (r.calls, r.cached_calls, round(r.spent_usd, 6), r.exhausted) for r in ledger.totals(ledger.read(spark, path)).collect()}


def test_a_batch_is_added_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    assert spent(spark, path) == {} and ledger.read(spark, path).collect() == []
    one = entries(spark, [("a", "t1", 0.5, False, "ok"), ("b", "t2", 0.25, True, "ok")])
    assert ledger.append(one, path, 0) and not ledger.append(one, path, 0) and ledger.append(one.where("run_id = 'a'"), path, 1)
    assert spent(spark, path) == {"a": (2, 0, 1.0, False), "b": (1, 1, 0.25, False), None: (3, 1, 1.25, False)}
    assert [r.batch for r in ledger.read(spark, path).orderBy("batch").collect()] == [0, 0, 1]
    assert folders.Folder(spark, path).names("_aside") == []


def test_lines_are_json_with_sorted_keys(spark):
    line = ledger.lines(entries(spark, [("a", None, 0.5, False, "ok")])).first().value
    assert line == '{"actual_usd":0.5,"cached":false,"model":null,"prompt":null,"reserved_usd":null,"run_id":"a","status":"ok","tokens_in":null,"tokens_out":null,"trace_id":null,"ts":null}'


def test_torn_and_odd_lines(spark, tmp_path):
    path = tmp_path / "ledger"
    (path / "batch=00000000000000000007").mkdir(parents=True)
    odd = ['{"actual_usd": 0.5, "run_id": "a"}', '{"actual_usd": "0.25", "run_id": "a"}', '{"actual_usd": null, "run_id": "a"}', '{"actual_usd": [1], "run_id": "a", "status": "budget_exhausted"}', '{"run_id": "b", "actual_usd": 1.0, "extra": {"x": 1}}', "", "   ", "[1, 2]", "7", '{"actual_usd": 9, "run']
    (path / "batch=00000000000000000007" / "part-0.txt").write_text("\n".join(odd))
    assert spent(spark, f"file://{path}") == {"a": (4, 0, 0.75, True), "b": (1, 0, 1.0, False), None: (5, 0, 1.75, True)}


def test_a_stream_that_is_sent_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        entries(spark, [("a", f"t{k}{j}", 0.5, False, "ok") for j in range(4)]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("run_id string, trace_id string, actual_usd double, cached boolean, status string").parquet(str(tmp_path / "in"))
    path = f"file://{tmp_path}/ledger"
    ledger.append_stream(stream(), path, str(tmp_path / "state")).awaitTermination(60)
    ledger.append_stream(stream(), path, str(tmp_path / "other state")).awaitTermination(60)  # all over, by the same numbers
    assert spent(spark, path)["a"] == (12, 0, 6.0, False)


def test_a_rename_never_moves_into_a_folder_or_over_it(spark, tmp_path):
    folder = folders.Folder(spark, f"file://{tmp_path}")
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(name)
    assert folder.rename_new("one", "there") and not folder.rename_new("two", "there") and (tmp_path / "there" / "x").read_text() == "one"
    assert folder.put_text("note", "é1") and not folder.put_text("note", "2") and folder.get_text("note") == "é1" and folder.get_text("none") is None
    assert folder.names() == ["note", "there", "two"]


@pytest.mark.parametrize("by", [None, "label"])
def test_ranks_are_exact(spark, by):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([0.0, 0.5, 0.5, 0.5, rng.random(), None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, label string, score double")
    got = {r.id: r["rank"] for r in ranks.ranked(df, [F.col("score").asc_nulls_last(), F.col("id")], by, partitions=7).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1] if by else 0, []).append(r)
    for group in groups.values():
        for k, r in enumerate(sorted(group, key=lambda r: (r[2] is None, r[2] or 0, r[0]))):
            assert got[r[0]] == k
    assert ranks.ranked(df.limit(0), [F.col("id")], by).collect() == []


def test_running_sums(spark):
    df = spark.createDataFrame([(k, k % 7, k / 2) for k in range(500)], "id long, n long, x double").repartition(5)
    got = {r.id: (r.n_before, r.x_before) for r in ranks.running_sums(df, [F.col("id").desc()], ["n", "x"], 4).collect()}
    assert got == {k: (sum(j % 7 for j in range(k + 1, 500)), sum(j / 2 for j in range(k + 1, 500))) for k in range(500)}


class Plain:
    """A budget as one would keep it by hand."""

    def __init__(self, most, cap, already):
        self.most, self.cap, self.already, self.spent, self.open = most, cap, already, 0.0, {}

    def apply(self, event, key, amount):
        held = sum(self.open.values())
        if event == "reserve":
            if key in self.open:
                return "open"
            if self.most is not None and self.spent + held + amount > self.most:
                return "budget_exhausted"
            if self.cap is not None and self.already + self.spent + held + amount > self.cap:
                return "ledger_cap"
            self.open[key] = amount
            return "reserved"
        if key not in self.open:
            return "not_open"
        del self.open[key]
        if event == "settle":
            self.spent += amount
        return f"{event}d"


def test_budget_events(spark):
    rng = random.Random(2)
    rows = [(f"r{k % 5}" if k % 5 else None, k, rng.choice(["reserve", "reserve", "settle", "release", "refund"]), f"c{rng.randrange(12)}", rng.choice([0.25, 0.5, 1.0, 4.0, None])) for k in range(2000)]
    df = spark.createDataFrame(rows, "run string, seq long, event string, id string, amount double").repartition(6)
    for most, cap in ((3.0, None), (50.0, 20.0), (None, None)):
        plain = {}
        want = {}
        for run, seq, event, key, amount in rows:
            b = plain.setdefault(run, Plain(most, cap, 1.5))
            status = b.apply(event, key, amount or 0.0) if event != "refund" else "invalid"
            want[seq] = (status, b.spent, sum(b.open.values()))
        folded = budget.fold_events(df, most, cap, 1.5)
        assert {r.seq: (r.status, r.spent, r.outstanding) for r in folded.collect()} == want
    totals = {r.run: r for r in budget.run_totals(folded).collect()}
    assert sum(r.n_settled for r in totals.values()) == sum(w[0] == "settled" for w in want.values()) and totals[None].spent == plain[None].spent
    assert budget.fold_events(df.limit(0), 1.0).collect() == []


def test_one_run_of_very_many_requests(spark):
    """A million requests of one run, in time and memory that follow their number."""
    df = spark.range(1_000_000).select(F.lit("one").alias("run"), F.col("id").alias("seq"), (F.col("id") % 10).cast("double").alias("amount"))
    got = budget.admit(df, 90_000.0).groupBy("admitted").agg(F.count("*").alias("n"), F.sum("amount").alias("usd")).collect()
    by = {r.admitted: (r.n, r.usd) for r in got}
    assert by[True][1] == 90_000.0 and by[True][0] + by[False][0] == 1_000_000


def test_totals_sort_events_once_and_without_fixed_limits(spark):
    df = spark.createDataFrame([("r", 1, "reserve", "a", 2.0), ("r", 1, "settle", "a", 1.5), ("r", 2, "reserve", "b", 9.0), (None, 1, "reserve", "a", 3.0)], "run string, seq long, event string, id string, amount double")
    for most in (5.0, F.lit(5.0)):
        totals = {r.run: r for r in budget.run_totals(budget.fold_events(df, most)).collect()}
        assert tuple(totals["r"])[1:] == (1, 1, 1, 0, 1.5, 0.0) and tuple(totals[None])[1:] == (1, 0, 0, 0, 0.0, 3.0)
    plan = budget.run_totals(budget.fold_events(df, 5.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "SortAggregate" not in plan and "AS most" not in plan
