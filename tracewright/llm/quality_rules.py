"""Quality rules with thresholds from the data: mergeable quantile sketches by language and source.

A sketch is a histogram of integer values with bins of a relative width of 1/64 (the top seven bits are kept), so sketches
merge by adding counts: task by task before the shuffle, sources to a language, languages to the corpus. A group's number
of bins is bounded by the width of an integer. Everything is integer arithmetic, so reruns and other engines agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.docstats import rule_stats
from tracewright.llm.storage import written
from tracewright.llm.textkernels import chunks, texts_of

#: Documents that a group's sketch needs; smaller groups use their language's sketch, or the corpus's.
LEAST_GROUP = 50
#: A value fails beyond the outer fence, the quartile and FENCE times the quartiles' distance, and this much slack.
FENCE = 3
SLACK = {"symbols": 50, "dup_lines": 200, "word_length": 200}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column(3))
        for i, j in chunks(texts):
            stats = rule_stats(texts[i:j])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), *(pa.array(stats[c], pa.int64()) for c in COUNTS)], ["doc_id", "lang", "source", *COUNTS])


def bin_of(value: Column) -> Column:
    """The lower end of the value's bin."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def _values() -> dict[str, Column]:
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "word_length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """lo and hi, the bins of the quartiles, and n of each group of keys, of a sketch (keys, bin, n)."""
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("total", F.sum("n").over(whole)).withColumn("run", F.sum("n").over(run))
    at = lambda part: F.min(F.when(4 * F.col("run") >= part * F.col("total"), F.col("bin")))
    return ranked.groupBy(*keys).agg(at(1).alias("lo"), at(3).alias("hi"), F.first("total").alias("n"))


def fences(stats: DataFrame) -> DataFrame:
    """By lang and source: the bounds of each value, from the group's sketch, else its language's, else the corpus's."""
    values = stats.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("value"), bin_of(v).alias("bin")) for k, v in _values().items()))).alias("x"))
    group = values.groupBy("lang", "source", "x.value", "x.bin").agg(F.count("*").alias("n"))
    language = group.groupBy("lang", "value", "bin").agg(F.sum("n").alias("n"))
    corpus = language.groupBy("value", "bin").agg(F.sum("n").alias("n"))
    named = lambda df, p: df.withColumnsRenamed({k: p + k for k in ("lang", "lo", "hi", "n", "value")})
    g = quartiles(group, ["lang", "source", "value"])
    m = named(quartiles(language, ["lang", "value"]), "l_")
    c = named(quartiles(corpus, ["value"]), "c_")
    joined = g.join(m, g.lang.eqNullSafe(m.l_lang) & (g.value == m.l_value)).join(c, g.value == c.c_value)
    pick = lambda k: F.when(F.col("n") >= LEAST_GROUP, F.col(k)).when(F.col("l_n") >= LEAST_GROUP, F.col("l_" + k)).otherwise(F.col("c_" + k))
    slack = F.create_map(*(F.lit(x) for kv in SLACK.items() for x in kv))[F.col("value")]
    out = joined.select("lang", "source", "value", pick("lo").alias("lo"), pick("hi").alias("hi"), slack.alias("slack"))
    low, high = F.col("lo") - FENCE * (F.col("hi") - F.col("lo")) - F.col("slack"), F.col("hi") + FENCE * (F.col("hi") - F.col("lo")) + F.col("slack")
    one = lambda name, v: F.max(F.when(F.col("value") == name, v))
    return out.groupBy("lang", "source").agg(one("symbols", high).alias("most_symbols"), one("dup_lines", high).alias("most_dup_lines"), one("word_length", low).alias("least_length"), one("word_length", high).alias("most_length"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """Counts, the fixed base rules and the adaptive verdict of each document.

    docs needs doc_id, text, lang and source; other columns are ignored. Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, the fences of its language and source, and kept. Sketches are of the documents
    that pass the base rules; a language and source with fewer than LEAST_GROUP of them takes its language's fences, and a language with fewer the corpus's. Null and empty texts have no words, so they fail the base rules. A null language or source is
    a group of its own. Repeated rows get equal results. An empty table gives an empty result.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    stats = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    stats = stats.mapInArrow(_counts, f"doc_id {doc_id}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    stats = stats.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    stats = written(stats, "rule-stats")
    bounds = fences(stats.where("NOT base_failed")).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = stats.join(bounds, stats.lang.eqNullSafe(bounds.f_lang) & stats.source.eqNullSafe(bounds.f_source), "left")
    v = _values()
    passes = (v["symbols"] <= F.col("most_symbols")) & (v["dup_lines"] <= F.col("most_dup_lines")) & v["word_length"].between(F.col("least_length"), F.col("most_length"))
    kept = ~F.col("base_failed") & F.coalesce(passes, F.lit(True))
    return joined.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "most_symbols", "most_dup_lines", "least_length", "most_length")
