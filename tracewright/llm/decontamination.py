"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item, or the whole item if it has fewer. Of each window the k-gram with the least hash
(the leftmost of equals) is the fingerprint, k being half of the window. Equal windows have equal fingerprints,
so every shared span that is long enough meets in the join of training and test fingerprints; neighbouring windows share theirs, so
few are kept. A document's matched fingerprints are then extended: the windows around them are compared as a whole, and the words
under equal windows are hit. Items of fewer words are winnowed by their own length, of which there are WINDOW at most.

Training fingerprints go through a plain equi-join with the distinct test fingerprints, which Spark broadcasts while it finds them
small and shuffles otherwise. What is known of a text is joined to all documents with that text by its digest: copies are combined
before each shuffle, and texts without a matched fingerprint are never moved. A text's own windows are all that meets in a row.

Hashes have 64 bits, fingerprint and window together 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.storage import scratch, written
from tracewright.llm.textkernels import chunks, inside, mix, rolling, signed, texts_of, words_of

WINDOW = 10
#: Characters between words: all of ASCII but digits and letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class _Winnowed:
    """Of all windows of some texts: their documents, first words, fingerprints and hashes."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, window: int):
        k = max(1, window // 2)
        grams = rolling(hashes, k, 0x5851F42D4C957F2D)
        n = max(0, len(hashes) - window + 1)
        self.place = np.flatnonzero(inside(first, window, len(hashes)))
        least, at = grams[:n].copy(), np.arange(n)
        for i in range(1, window - k + 1):
            less = grams[i : i + n] < least
            least[less] = grams[i : i + n][less]
            at[less] = np.flatnonzero(less) + i
        self.doc = np.searchsorted(first, self.place, "right") - 1
        self.start = self.place - first[self.doc]
        #: Windows of other lengths have other fingerprints.
        self.print = mix(least[self.place] + np.uint64(window))
        self.at = at[self.place]
        self.window = rolling(hashes, window, 0x2545F4914F6CDD1D)[self.place]


def _item_windows(window: int):
    """(item_id, print, window, length) of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for i, j in chunks(texts):
                words = words_of(texts[i:j], _BETWEEN)
                hashes, counts, part = words.hashes(lower=True), words.counts, ids.slice(i, j - i)
                for length in sorted(set(np.minimum(counts, window).tolist()) - {0}):
                    own = np.flatnonzero(counts == length if length < window else counts >= window)
                    at = np.repeat(words.first[own] - np.cumsum(counts[own]) + counts[own], counts[own]) + np.arange(counts[own].sum())
                    w = _Winnowed(hashes[at], np.append(0, np.cumsum(counts[own])), length)
                    yield pa.RecordBatch.from_arrays(
                        [part.take(pa.array(own[w.doc])), pa.array(signed(w.print)), pa.array(signed(w.window)), pa.array(np.full(len(w.doc), length, np.int32))], ["item_id", "print", "window", "length"]
                    )

    return run


def _fingerprints(lengths: list[int]):
    """(text_key, prints): the fingerprints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in chunks(texts):
                words = words_of(texts[i:j], _BETWEEN)
                hashes, doc, prints = words.hashes(lower=True), [], []
                for length in lengths:
                    w = _Winnowed(hashes, words.first, length)
                    new = np.ones(len(w.at), bool)  # the next window mostly has the same one, at the same place
                    new[1:] = w.at[1:] != w.at[:-1]
                    doc.append(w.doc[new])
                    prints.append(w.print[new])
                doc, prints = np.concatenate(doc), np.concatenate(prints)
                order = np.argsort(doc, kind="stable")
                first = np.append(0, np.cumsum(np.bincount(doc, minlength=j - i))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(first, pa.array(signed(prints[order])))], ["text_key", "prints"])

    return run


def _extended(lengths: list[int]):
    """(text_key, print, window, start): windows of a text around its matched fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in chunks(texts):
                words = words_of(texts[i:j], _BETWEEN)
                hashes, part, keys = words.hashes(lower=True), batch.column(2).slice(i, j - i), batch.column(0).slice(i, j - i)
                offsets = part.offsets.to_numpy()
                known = part.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).view(np.uint64)
                known = np.unique(mix(known + mix(np.repeat(np.arange(j - i), np.diff(offsets)).astype(np.uint64))))
                for length in lengths:
                    w = _Winnowed(hashes, words.first, length)
                    hit = np.isin(mix(w.print + mix(w.doc.astype(np.uint64))), known)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(w.doc[hit])), pa.array(signed(w.print[hit])), pa.array(signed(w.window[hit])), pa.array(w.start[hit])], ["text_key", "print", "window", "start"]
                    )

    return run


def _covered(spans: Column) -> Column:
    """The number of words under spans (start, end), which ascend."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    return F.aggregate(
        spans, zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")), lambda a: a["n"]
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Which words of the documents stand in a window of a benchmark item.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. Returns for each row of docs doc_id, n_words,
    n_hit (words under equal windows), n_items, items_sha256 (of the ids of the items with such a window, sorted as strings and joined by
    commas), contaminated, spans (of hit windows, first and past-the-end word, ascending, overlapping) and items. Words are
    runs of digits, letters and all beyond ASCII, compared with A-Z in lower case. Null, empty and blank texts have no words and no
    windows, on both sides. Repeated documents each get a row; repeated items, and items with one id, count once. A window of an item without
    an id is hit but not counted in n_items. Texts of any length are taken whole. Without items nothing is hit; an empty table of documents gives
    an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    texts = rows.select("text_key", "text")
    with scratch() as block:
        kind = "item_id string, print long, window long, length int"
        items = written(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_windows(window), kind).distinct(), "items")
        lengths = sorted(r.length for r in items.select("length").distinct().collect())  # `window` rows at most
        matched = (
            texts.mapInArrow(_fingerprints(lengths), "text_key binary, prints array<long>")
            .select("text_key", F.explode("prints").alias("print"))
            .join(written(items.select("print").distinct(), "fingerprints"), "print")
            .groupBy("text_key")
            .agg(F.collect_set("print").alias("prints"))
        ) if lengths else texts.limit(0).select("text_key", F.array().cast("array<long>").alias("prints"))
        matched = written(matched, "matched")
        some = texts.join(written(matched.select("text_key"), "matched-texts"), "text_key", "left_semi")
        around = some.join(matched, "text_key").select("text_key", "text", "prints").mapInArrow(_extended(lengths), "text_key binary, print long, window long, start long")
        hits = around.join(items.select("print", "window", "length").distinct(), ["print", "window"]).distinct()
        hits = written(hits, "window-hits")
        spans = hits.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
        found = hits.select("text_key", "print", "window").distinct().join(items, ["print", "window"]).groupBy("text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        known = block.out(spans.join(found, "text_key").withColumn("n_hit", _covered(F.col("spans"))), "contamination")
    n_items = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    digest = F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256)
    return (
        rows.select("doc_id", "text_key", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"))
        .join(known, "text_key", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(n_items).cast("long").alias("n_items"),
            digest.alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "spans", "items",
        )
    )
