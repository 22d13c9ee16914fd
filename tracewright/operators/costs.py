"""Prices, reservations under a cap, and the ledger of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scores import actual_usd, reservation_usd
from tracewright.operators.budget import admit


def prices(models: DataFrame, listing: DataFrame, overrides: DataFrame) -> DataFrame:
    """model, price_in and price_out: an override where there is one, else the highest of the listed endpoints; unknown stays null."""
    most = listing.groupBy("model").agg(F.max("price_in").alias("l_in"), F.max("price_out").alias("l_out"))
    given = overrides.select("model", F.col("price_in").alias("o_in"), F.col("price_out").alias("o_out"))
    joined = models.select("model").distinct().join(given, "model", "left").join(most, "model", "left")
    return joined.select("model", F.coalesce("o_in", "l_in").alias("price_in"), F.coalesce("o_out", "l_out").alias("price_out"))


def reservation_plan(calls: DataFrame) -> DataFrame:
    """n_calls and reserved_usd of each run, and of all (run null), of calls (run, chars, max_tokens, price_in, price_out)."""
    worst = calls.withColumn("usd", reservation_usd(F.col("chars"), F.col("max_tokens"), F.col("price_in"), F.col("price_out")))
    return worst.rollup("run").agg(F.count("*").alias("n_calls"), F.sum("usd").alias("reserved_usd"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """calls, cached calls, spent and refused of each run."""
    return ledger.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cached_calls"), F.sum(F.coalesce(F.col("actual_usd").try_cast("double"), F.lit(0.0))).alias("spent_usd"), F.bool_or(F.col("status") == "budget_exhausted").alias("exhausted")
    )


__all__ = ["actual_usd", "admit", "ledger_summary", "prices", "reservation_plan"]
