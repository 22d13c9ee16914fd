"""Budgets of runs as state: reservations against a cap, settled at what they cost or released.

A run's events are decided one after the other, as a refused request uses nothing up and a later, smaller one may pass. Events are
shuffled by run, sorted by their place, and folded as they stream through the task: what a task holds is a run's sums and its open reservations,
however many events the run has, and its time is linear in them. Runs are independent and many.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = ("reserve", "settle", "release")
LIMITS = ("most", "cap", "already")
RESULT = "run string, seq long, event string, id string, amount double, status string, spent double, outstanding double, place long"


class RunBudget:
    """Spent and reserved sums of one run."""

    def __init__(self, already: float):
        self.spent = self.outstanding = 0.0
        self.already = already
        self.open: dict[str, float] = {}

    def apply(self, event: str, key: str, amount: float, most: float | None, cap: float | None) -> str:
        """What an event comes to. A call's money is spent when it is settled, in the run and in the lifetime sum alike."""
        if event == "reserve":
            if key in self.open:
                return "open"
            if most is not None and self.spent + self.outstanding + amount > most:
                return "budget_exhausted"
            if cap is not None and self.already + self.spent + self.outstanding + amount > cap:
                return "ledger_cap"
            self.open[key] = amount
            self.outstanding += amount
            return "reserved"
        held = self.open.pop(key, None)
        if held is None:
            return "not_open"
        self.outstanding -= held
        if not self.open:
            self.outstanding = 0.0  # no rests of rounding
        if event == "settle":
            self.spent += amount
            return "settled"
        return "released"


def _folded(fixed: dict[str, float | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, place = object(), None, 0
        for batch in batches:
            limit = {n: [fixed[n]] * batch.num_rows if n in fixed else batch.column(n).to_pylist() for n in LIMITS}
            runs, events, ids, amounts = (batch.column(n).to_pylist() for n in ("run", "event", "id", "amount"))
            status, spent, outstanding, places = [], [], [], []
            for k, name in enumerate(runs):
                if state is None or name != last:
                    last, state, place = name, RunBudget(limit["already"][k] or 0.0), 0
                status.append(state.apply(events[k], ids[k], amounts[k] or 0.0, limit["most"][k], limit["cap"][k]) if events[k] in EVENTS else "invalid")
                spent.append(state.spent)
                outstanding.append(state.outstanding)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("run", "seq", "event", "id", "amount")), pa.array(status, pa.string()), pa.array(spent, pa.float64()), pa.array(outstanding, pa.float64()), pa.array(places, pa.int64())],
                ["run", "seq", "event", "id", "amount", "status", "spent", "outstanding", "place"],
            )

    return run


def fold_events(events: DataFrame, most: Column | float | None, cap: Column | float | None = None, already: Column | float = 0.0) -> DataFrame:
    """Each event of a run with what it came to and the run's sums after it.

    events: run, seq (its place in the run; ties by id and event), event (reserve, settle or release), id (of the call), amount (reserved, or what the
    call cost). `most` is the run's budget, `cap` the lifetime cap and `already` what the ledger had spent before: numbers, or columns of events that are constant in a
    run. status: reserved, budget_exhausted, ledger_cap (these two reserve nothing), open (the id holds a reservation already),
    settled, released, not_open (never reserved, or settled or released before) or invalid (no such event). A null amount counts as 0,
    null caps as none; null is a run of its own. place: the event's, from 0, in its run. An empty table gives an empty one.
    """
    limits = dict(zip(LIMITS, (most, cap, already), strict=True))
    fixed = {n: c if c is None else float(c) for n, c in limits.items() if not isinstance(c, Column)}  # these aren't sorted with each event
    rows = events.select(
        F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), F.col("event").cast("string").alias("event"), F.col("id").cast("string").alias("id"), F.col("amount").cast("double").alias("amount"),
        *(c.cast("double").alias(n) for n, c in limits.items() if n not in fixed),
    )
    return rows.repartition("run").sortWithinPartitions("run", "seq", "id", "event").mapInArrow(_folded(fixed), RESULT)


def _admitted(kinds: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, spent, begun = None, 0.0, False
        for batch in batches:
            runs, amounts, caps, flags = batch.column("run").to_pylist(), batch.column("amount").cast(pa.float64()).to_pylist(), batch.column("_cap").to_pylist(), []
            for name, amount, cap in zip(runs, amounts, caps, strict=True):
                if not begun or name != last:
                    last, spent, begun = name, 0.0, True
                fits = amount is not None and spent + amount <= cap
                spent += amount if fits else 0.0
                flags.append(fits)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kinds), pa.array(flags, pa.bool_())], [*kinds, "admitted"])

    return run


def admit(requests: DataFrame, cap: float) -> DataFrame:
    """run, seq, amount and admitted of requests that are never settled for less, in the order of seq (ties by amount) within a run.

    A request that doesn't fit uses nothing up, so a later, smaller one may pass. A null amount is refused.
    """
    rows = requests.select("run", "seq", "amount", F.lit(float(cap)).alias("_cap"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "_cap"}
    schema = ", ".join([*(f"{n} {k}" for n, k in kinds.items()), "admitted boolean"])
    return rows.repartition("run").sortWithinPartitions("run", "seq", "amount").mapInArrow(_admitted(kinds), schema)


def run_totals(folded: DataFrame) -> DataFrame:
    """run, n_reserved, n_refused, n_settled, n_released, spent and reserved_left of folded events.

    The last event is that of the largest place, a number: so a task holds a row for each run, and sorts no events again.
    """
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    last = lambda c: F.max_by(c, "place")
    return folded.groupBy("run").agg(
        n("reserved").alias("n_reserved"), n("budget_exhausted", "ledger_cap").alias("n_refused"), n("settled").alias("n_settled"), n("released").alias("n_released"), last("spent").alias("spent"), last("outstanding").alias("reserved_left")
    )
