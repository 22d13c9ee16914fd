"""Mixing sources to target weights, in words.

Each document gets a hash-random key. Within its source the keys are cut into as many ranges as the root of its rows, of as
many rows each; sums are prefixed over the ranges of a source and over the documents inside a range. A source of n rows is
spread over tasks of about sqrt(n) rows, so no task holds a source. Budgets are shared by weight and capped with a window over one row for
each source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.storage import written
from tracewright.llm.textkernels import chunks, texts_of, words_of


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(2))
        for i, j in chunks(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(words_of(texts[i:j]).counts, pa.int64())], ["doc_id", "source", "size"])


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """source, source_size, target of sources (source, source_size).

    The sources, by code point with null last, have the weights in turn and share `percent` hundredths of all sizes. A target
    stops at `most` times its source's size; the excess is shared again by weight until no target is above. Equally: a source
    with the i-th least ratio of cap to weight is capped while the level, what is left for each unit of weight, is over it.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    s = s.withColumns(
        {
            "left_size": F.sum("source_size").over(whole) * F.lit(percent) / 100.0 - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", F.col("left_size") / F.col("left_weight"))
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(whole)
    target = F.coalesce(F.least(free["level"] * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2, seed: int = 0) -> DataFrame:
    """How many words of each document the mix takes.

    docs needs doc_id, source and text; other columns are ignored. Returns doc_id, size, source_size, target and taken. A source
    goes in whole as often as it fits its target, then in the order of its keys until the target, rounded down, is met: the
    document at the cut gives its first words. Null and empty texts have size 0 and give nothing. Null is a source of its
    own. Repeated rows are documents of their own. The key is a hash of the seed and doc_id, so reruns agree; rows
    without a doc_id share one key and are taken by their size. An empty table gives an empty result.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(_sizes, f"doc_id {doc_id}, source string, size long")
    sized = written(sized.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranges = F.ceil(F.sqrt("rows"))
    goal = targets(totals.select("source", "source_size"), weights, percent, most)
    goal = goal.join(totals.select(F.col("source").alias("s"), ranges.alias("ranges")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "g_source")
    placed = sized.join(goal, sized.source.eqNullSafe(goal.g_source)).drop("g_source")
    # The key's first 32 bits, as a share of all, times the number of ranges: ranges ascend with the keys.
    placed = placed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32)))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("p_source"), F.col("range").alias("p_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    run = run.join(sums, run.source.eqNullSafe(sums.p_source) & (run.range == sums.p_range))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("ahead") - F.col("inside")
    taken = F.col("size") * epochs + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return run.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
