"""Tables of the evaluation report, over predictions (detector, trace_id, split, domain, kind, evidence, label, p, verdict, abstain)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.metrics import auroc, calibration


#: Letters that a short passage is looked up by.
_LETTERS = 8


def recall_by_kind(predictions: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind, total and caught false successes of each kind, kinds without any included."""
    counts = predictions.where("label = 0").groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "false_success").alias("caught"))
    return kinds.join(counts, "kind", "left").fillna(0, ["total", "caught"])


def evidence_breakdown(predictions: DataFrame) -> DataFrame:
    missed = predictions.groupBy("evidence").agg(F.count("*").alias("n"), F.count_if((F.col("label") == 0) & (F.col("verdict") == "verified")).alias("missed"))
    return missed.join(auroc(predictions, ["evidence"], score="p").select("evidence", "auroc"), "evidence")


def abstain_rates(predictions: DataFrame) -> DataFrame:
    """Abstentions of each detector: the share on the test split, and the count on all."""
    test = F.col("split") == "test"
    return predictions.groupBy("detector").agg(F.count_if("abstain").alias("abstained"), (F.count_if(F.col("abstain") & test) / F.nullif(F.count_if(test), F.lit(0))).alias("test_share"))


def cells(traces: DataFrame, keys: Sequence[str] = ("split", "domain", "kind", "evidence")) -> DataFrame:
    return traces.groupBy(*keys).agg(F.count("*").alias("n"))


def composition(traces: DataFrame, by: str = "domain") -> DataFrame:
    """by, train, test and total."""
    return traces.groupBy(by).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"), F.count("*").alias("total"))


def best_detector(predictions: DataFrame) -> DataFrame:
    """The detector with the best AUROC on the train split, of equal ones that of the lower Brier score, then the first by name."""
    train = predictions.where("split = 'train'")
    table = auroc(train, ["detector"], score="p").join(calibration(train, ["detector"]), "detector")
    return table.select("detector", "auroc", "brier").orderBy(F.col("auroc").desc_nulls_last(), "brier", "detector").limit(1)


def cheapest_model(prices: DataFrame) -> DataFrame:
    return prices.where("price_in IS NOT NULL AND price_out IS NOT NULL").agg(F.min_by("model", F.struct(F.col("price_in") + F.col("price_out"), F.col("model"))).alias("model"))


def latest(results: DataFrame, key: str = "trace_id", order: str = "line_no") -> DataFrame:
    """One row for each key: the one that comes last."""
    rest = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def first_of_each(rows: DataFrame, n: int, by: str = "split", order: str = "line_no") -> DataFrame:
    """The first n rows of each group: an ordered top-n that Spark cuts before the shuffle."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def feature_auroc(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """The AUROC of each single feature, the furthest from a half first."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in names)))
    long = features.select("label", pairs.alias("x")).select("label", "x.feature", "x.value")
    return auroc(long, ["feature"], score="value").select("feature", "auroc").withColumn("distance", F.abs(F.col("auroc") - 0.5)).orderBy(F.col("distance").desc(), "feature").drop("distance")


def standardisation(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each feature; a deviation of 0 counts as 1."""
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in names)))
    table = features.select(one.alias("x")).select("x.*").groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))
    return table.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def contained(passages: DataFrame, texts: DataFrame, words: int = 5, apart: bool = False) -> DataFrame:
    """(passage_id, text_id) where a passage (passage_id, passage) is part of a text (text_id, body); apart: only of texts of another side (side, in both).

    A passage of `words` + 2 words or more holds whole words inside its first and last one. Its first `words` of these are
    looked up among the runs of words of the texts; a shorter one, by its first letters among all runs of so many letters. Texts send the runs
    that some passage has, once for each passage, both are equi-joins, and what meets is settled by the texts themselves. The empty passage is part of every text.
    """
    # Words as hashes: a run's key is made of its words' hashes, so no run is put together as a text.
    split = lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    side = ["side"] if apart else []
    p = passages.where("passage IS NOT NULL").withColumn("w", split("passage")).select("passage_id", "passage", *side, "w", F.least(F.char_length("passage"), F.lit(_LETTERS)).alias("n"))
    by_words = F.size("w") >= words + 2
    key = F.when(by_words, F.xxhash64(*(F.get("w", F.lit(1 + j)) for j in range(words)))).otherwise(F.xxhash64(F.col("n"), F.substr("passage", F.lit(1), F.col("n"))))
    keyed = p.select("passage_id", *(F.col(c).alias("own") for c in side), F.when(by_words, -1).otherwise(F.col("n")).alias("n"), key.alias("key"))
    kinds = {r.n for r in keyed.select("n").distinct().collect()}  # _LETTERS + 2 at most

    def letter_runs(n: int) -> Column:
        """Keys of the runs of n letters, marked with their number."""
        places = F.sequence(F.lit(1), F.greatest(F.size("letters") - n + 1, F.lit(1)))
        return F.transform(places, lambda k: F.xxhash64(F.lit(n), F.array_join(F.slice("letters", k, n), "")))

    # The last few runs of a text are short ones, which are no passage's key but by chance.
    runs = [F.transform("w", lambda w, k: F.xxhash64(w, *(F.get("w", k + j) for j in range(1, words))))] if -1 in kinds else []
    runs += [letter_runs(n) for n in sorted(kinds - {-1})]
    if not runs:
        return passages.select("passage_id").crossJoin(texts.select("text_id")).limit(0)
    # Columns of their own, so that a text is split once and not for each run.
    parted = texts.where("body IS NOT NULL").withColumn("w", split("body")).withColumn("letters", F.split("body", "", -1) if kinds - {-1} else F.lit(None).cast("array<string>"))
    each = parted.select("text_id", *side, F.explode(runs[0] if len(runs) == 1 else F.flatten(F.array(*runs))).alias("key"))
    # The keys of the passages go to the texts' runs first, which Spark does by broadcast while they are few.
    found = each.join(keyed.drop("n"), "key")
    if apart:
        found = found.where("own != side")
    found = found.select("passage_id", "text_id").distinct()
    return found.join(p.select("passage_id", "passage"), "passage_id").join(texts.select("text_id", "body"), "text_id").where(F.contains("body", F.col("passage"))).select("passage_id", "text_id")
