"""A live run of judges over traces: what a call may cost is reserved, calls go out in rounds under the budget, answers are cached, and every call is in the ledger and in the record.

Nothing is asked twice: what the cache knows costs nothing. A call whose model has no price isn't made. In each round the calls that fit under what is left of the
budget, at the most they may cost, go out, in the order of detector and trace; what they really cost is spent, and the next round has the rest. The last round
is the one in which nothing fits any more. Each round is a batch of the ledger, so a run that is taken up again after a crash pays for no round twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scores import actual_usd, reservation_usd
from tracewright.operators.budget import admit
from tracewright.operators.judge import parse_judgments
from tracewright.operators.ranks import ranked
from tracewright.operators.transport import Policy, Send, call_all
from tracewright.sources.folders import pinned
from tracewright.sources.judge_cache import JudgeCache
from tracewright.streaming import ledger

#: What a call must have to be made: requests are trace_id, split, detector, model, prompt_name, request, cache_key and max_tokens.
COLUMNS = ("trace_id", "split", "detector", "model", "prompt_name", "request", "cache_key", "max_tokens")


def plan(requests: DataFrame, prices: DataFrame, cache: JudgeCache) -> DataFrame:
    """requests with amount (what the call may cost), cached, and seq, its place in the run. A model without a price has no amount; cached calls cost nothing."""
    known = cache.read().select("cache_key", F.lit(True).alias("_known"))
    priced = requests.join(known, "cache_key", "left").join(prices.select("model", "price_in", "price_out"), "model", "left").withColumn("cached", F.coalesce("_known", F.lit(False)))
    most = reservation_usd(F.char_length("request"), F.col("max_tokens"), F.col("price_in"), F.col("price_out"))
    each = priced.withColumn("amount", F.when(F.col("cached"), 0.0).otherwise(most))
    placed = ranked(each.select(*COLUMNS, "price_in", "price_out", "cached", "amount"), [F.col("detector"), F.col("trace_id"), F.col("split"), F.col("cache_key")], name="seq")
    return pinned(placed, "plan")


def preflight(planned: DataFrame) -> DataFrame:
    """detector, n_calls, n_cached, n_unpriced and reserved_usd: what the run may cost at most, before any call."""
    return planned.groupBy("detector").agg(F.count("*").alias("n_calls"), F.count_if("cached").alias("n_cached"), F.count_if(F.col("amount").isNull()).alias("n_unpriced"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("reserved_usd"))


def _usage(name: str) -> object:
    return F.try_variant_get(F.try_parse_json("usage"), f"$.{name}", "double")


def run(planned: DataFrame, cache: JudgeCache, connect: Callable[[], Send], run_id: str, ledger_path: str, max_usd: float, policy: Policy = Policy(), real: bool = True) -> DataFrame:
    """Answers to a plan: its columns with content, usage, failure, latency_ms, cost_usd and reserved_usd; a row for each request.

    failure: unknown_price and budget_exhausted for calls that weren't made, else one of the transport's. Equal requests of a round are one call, which the first of
    them pays.
    """
    free = {"cached": F.lit(True), "failure": F.lit(None).cast("string"), "latency_ms": F.lit(0.0), "cost_usd": F.lit(0.0)}
    known = lambda df: df.join(cache.read(), "cache_key").withColumns(free).select(*planned.columns, "content", "usage", "failure", "latency_ms", "cost_usd")
    hits = pinned(known(planned.where("cached")), "hits")
    left = planned.where("NOT cached AND amount IS NOT NULL")
    nothing = lambda df, why: df.select(*planned.columns, *(F.lit(None).cast("string").alias(c) for c in ("content", "usage")), F.lit(why).alias("failure"), F.lit(0.0).alias("latency_ms"), F.lit(0.0).alias("cost_usd"))
    done, spent, number = [hits, nothing(planned.where("NOT cached AND amount IS NULL"), "unknown_price")], 0.0, 0
    while True:
        flags = pinned(admit(left.select(F.lit(run_id).alias("run"), "seq", "amount"), max_usd - spent), "admitted").select("seq", "admitted")
        now = left.join(flags.where("admitted"), "seq", "left_semi")
        if now.isEmpty():
            break
        # Of equal requests one is asked, the first.
        one = now.groupBy("cache_key").agg(F.min_by(F.struct("request", "seq"), "seq").alias("r")).select("cache_key", "r.request", F.col("r.seq").alias("_payer"))
        asked = pinned(call_all(one.repartition("cache_key"), connect, policy, real), f"round-{number}")
        cache.merge(asked)
        cost = F.when(F.col("failure").isNull() & (F.col("seq") == F.col("_payer")), F.coalesce(actual_usd(_usage("cost"), F.coalesce(_usage("prompt_tokens"), F.lit(0.0)), F.coalesce(_usage("completion_tokens"), F.lit(0.0)), F.col("price_in"), F.col("price_out")), F.lit(0.0))).otherwise(0.0)
        answers = pinned(now.join(asked, "cache_key").withColumn("cost_usd", cost).select(*planned.columns, "content", "usage", "failure", "latency_ms", "cost_usd"), f"answers-{number}")
        ledger.append(entries(answers, run_id), ledger_path, number)
        spent += answers.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]
        done.append(answers)
        left = pinned(left.join(flags.where("admitted"), "seq", "left_anti"), "left")
        # What equals a request of this round is known now.
        met = pinned(known(left), "met")
        done.append(met)
        left = left.join(met.select("seq"), "seq", "left_anti")
        number += 1
    out = done[0]
    for part in [*done[1:], nothing(left, "budget_exhausted")]:
        out = out.unionByName(part)
    rest = out.where(F.col("cached") | F.col("failure").isin("unknown_price", "budget_exhausted"))
    ledger.append(entries(rest, run_id), ledger_path, number)
    return out


def entries(answers: DataFrame, run_id: str) -> DataFrame:
    """Lines of the ledger: no content of traces."""
    token = lambda c: F.coalesce(_usage(c), F.lit(0.0)).cast("long")
    return answers.select(
        F.lit(run_id).alias("run_id"), "model", "trace_id", F.col("prompt_name").alias("prompt"), token("prompt_tokens").alias("tokens_in"), token("completion_tokens").alias("tokens_out"),
        F.coalesce("amount", F.lit(0.0)).alias("reserved_usd"), F.col("cost_usd").alias("actual_usd"), "cached", F.coalesce("failure", F.lit("ok")).alias("status"),
    )


def records(answers: DataFrame, valid_steps: DataFrame, prompts: DataFrame) -> DataFrame:
    """The columns of judge-records.jsonl: parsed answers with the digests of their prompt and request. A failure abstains with its word.

    valid_steps: trace_id and steps (array<bigint>), or empty. prompts: prompt_name and prompt.
    """
    own = answers.withColumn("_id", F.concat_ws("\n", F.coalesce("detector", F.lit("")), F.coalesce("split", F.lit("")), "trace_id"))
    steps = own.select("_id", "trace_id").join(valid_steps, "trace_id").select(F.col("_id").alias("trace_id"), "steps")
    parsed = parse_judgments(own.select(F.col("_id").alias("trace_id"), "content"), steps).withColumnRenamed("trace_id", "_id")
    joined = own.drop("abstain").join(parsed, "_id").join(prompts.select("prompt_name", F.sha2("prompt", 256).alias("prompt_sha256")), "prompt_name", "left")
    return joined.select(
        "detector", "trace_id", "split", "model", "prompt_name", "prompt_sha256", F.sha2("request", 256).alias("request_sha256"), F.col("p").alias("p_raw"), F.lit(None).cast("double").alias("p_cal"), "abstain",
        F.coalesce("failure", "abstain_reason").alias("abstain_reason"), "failure_kind", "latency_ms", "cost_usd", "cached",
    )
