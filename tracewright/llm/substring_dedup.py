"""Substring dedup by relative Lempel-Ziv parsing against all earlier documents.

The reference of a document is every document with a smaller id. It is indexed by anchors: of the 7-word grams in
each 13-word window the one with the least hash. Equal windows have equal anchors, and consecutive anchors of a
document overlap or touch. The index is a table of anchors (hash, least document, place), partitioned by hash, so
each of its blocks holds the phrases of a hash range of the whole reference.

A document is factored greedily from left to right: anchors whose earliest occurrences lie in one source document
on one diagonal form a factor, a proven copy of a stretch of that source. A window inside a factor is a duplicate.
Windows that cross the boundary of a factor are looked up one by one in a second index, of window fingerprints,
which only holds windows at such boundaries and at first occurrences. So what is shuffled follows the number of
anchors (a quarter of the words) and of factors, not of windows, and the result is that of comparing all windows.

Hot phrases: counts are combined before each shuffle, and the joins are plain equi-joins that adaptive execution
splits where a hash is hot. No group of documents is ever collected; what meets in a row is one document's own
anchors.

Fingerprints have 64 bits for an anchor and 64 more for a window beside its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.storage import written
from tracewright.llm.textkernels import chunks, inside, mix, rolling, signed, texts_of, words_of

WINDOW = 13
_PLACE_BITS = 40


class _Parsed:
    """Anchors of a chunk of documents, for windows of `window` words and grams of `gram` words."""

    def __init__(self, texts: list[bytes], window: int):
        self.gram = window // 2 + 1
        across = window - self.gram + 1
        self.window, self.words = window, words_of(texts)
        self.hashes = self.words.hashes()
        grams = rolling(self.hashes, self.gram, 0x5851F42D4C957F2D)
        total = len(self.hashes)
        self.ok = np.flatnonzero(inside(self.words.first, window, total))
        n = max(0, total - window + 1)
        best, at = grams[:n].copy(), np.arange(n)
        for i in range(1, across):
            less = grams[i : i + n] < best
            best[less] = grams[i : i + n][less]
            at[less] = np.flatnonzero(less) + i
        #: For each window: its document and the word at which its anchor starts; for each anchor: that word and its hash.
        self.doc = np.searchsorted(self.words.first, self.ok, "right") - 1
        self.anchor_of = at[self.ok]
        self.anchor, self.of_window = np.unique(self.anchor_of, return_inverse=True)
        self.anchor_hash = grams[self.anchor]
        self.anchor_doc = np.searchsorted(self.words.first, self.anchor, "right") - 1

    def window_prints(self) -> np.ndarray:
        return rolling(self.hashes, self.window, 0x2545F4914F6CDD1D)[self.ok]


def _place(parsed: _Parsed, texts: list[bytes]) -> np.ndarray:
    """The anchors' words in their documents, below a few bits of the text, so that two texts with one id stay apart."""
    marks = np.array([hash_text(t) for t in texts], np.int64)
    return parsed.anchor - parsed.words.first[parsed.anchor_doc] + (marks[parsed.anchor_doc] << _PLACE_BITS)


def hash_text(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=2).digest(), "little")


def _anchors(window: int, placed: bool):
    """(hash, doc_id, place), or (hash, text_id), once for each hash of a document. The first column holds doc_id or text_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), texts_of(batch.column(1))
            for i, j in chunks(texts):
                p = _Parsed(texts[i:j], window)
                order = np.lexsort((p.anchor, p.anchor_hash, p.anchor_doc))
                d, h = p.anchor_doc[order], p.anchor_hash[order]
                keep = np.ones(len(order), bool)
                keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                order = order[keep]
                columns = [pa.array(signed(p.anchor_hash[order])), pa.array(ids[i:j][p.anchor_doc[order]])]
                if placed:
                    columns.append(pa.array(_place(p, texts[i:j])[order]))
                yield pa.RecordBatch.from_arrays(columns, ["hash", "doc_id", "place"] if placed else ["hash", "text_id"])

    return run


class _Factored:
    """A chunk parsed against its documents' hits (hash, source, place): which windows are proven, which to look up."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, hits: pa.Array, window: int):
        self.parsed = p = _Parsed(texts, window)
        lens = np.diff(hits.offsets.to_numpy())
        lo, hi = hits.offsets[0].as_py(), hits.offsets[-1].as_py()
        flat = hits.values.slice(lo, hi - lo)
        h, source, place = (flat.field(k).to_numpy() for k in ("hash", "source", "place"))
        doc = np.repeat(np.arange(len(texts)), np.where(np.asarray(hits.is_valid()), lens, 0))
        key = mix(h.view(np.uint64) + mix(doc.astype(np.uint64)))
        order = np.argsort(key)
        key = key[order]
        want = mix(p.anchor_hash + mix(p.anchor_doc.astype(np.uint64)))
        at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
        self.shared = key[at] == want if len(key) else np.zeros(len(want), bool)
        at = order[at] if len(key) else at
        src, there = (x[at] if len(x) else np.zeros(len(at), np.int64) for x in (source, place))
        own = ids[p.anchor_doc]
        self.copied = self.shared & (src < own)
        self.first = self.shared & (src == own)
        # Factors: runs of copied anchors with one source and one diagonal that overlap or touch.
        line = there - (p.anchor - p.words.first[p.anchor_doc])
        linked = np.zeros(len(p.anchor), bool)
        if len(p.anchor) > 1:
            linked[1:] = self.copied[1:] & self.copied[:-1] & (src[1:] == src[:-1]) & (line[1:] == line[:-1]) & (p.anchor_doc[1:] == p.anchor_doc[:-1]) & (np.diff(p.anchor) <= p.gram)
        run = np.cumsum(~linked) - 1
        start = p.anchor[~linked]
        end = p.anchor[np.append(np.flatnonzero(~linked)[1:] - 1, len(p.anchor) - 1)] + p.gram if len(p.anchor) else p.anchor
        of = run[p.of_window]
        self.proven = self.copied[p.of_window] & (start[of] <= p.ok) & (p.ok + window <= end[of]) if len(p.ok) else np.zeros(0, bool)


def _boundary_windows(window: int):
    """(hash, print, doc_id, text_id, asks): windows to look up, and those at first occurrences that may answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            ids, texts, hits, rows = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1)), batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            for i, j in chunks(texts):
                f = _Factored(texts[i:j], ids[i:j], hits.slice(i, j - i), window)
                p = f.parsed
                which = np.flatnonzero(f.shared[p.of_window] & ~f.proven)
                prints = p.window_prints()[which]
                _, once = np.unique(mix(prints + mix(p.doc[which].astype(np.uint64))), return_index=True)
                which, prints = which[once], prints[once]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(p.anchor_hash[p.of_window[which]])), pa.array(signed(prints)), pa.array(ids[i:j][p.doc[which]]), pa.array(rows[i:j][p.doc[which]]), pa.array(f.copied[p.of_window[which]])],
                    ["hash", "print", "doc_id", "text_id", "asks"],
                )

    return run


def _cut(window: int):
    """Per document: the number of words, of removed words, the kept text and the spans of words that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, texts, hits, found = batch.column(0), texts_of(batch.column(1)), batch.column(2), batch.column(3)
            ids = raw.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            for i, j in chunks(texts):
                f = _Factored(texts[i:j], ids[i:j], hits.slice(i, j - i), window)
                p = f.parsed
                part = found.slice(i, j - i)
                lo, hi = part.offsets[0].as_py(), part.offsets[-1].as_py()
                prints = part.values.slice(lo, hi - lo).to_numpy(zero_copy_only=False).view(np.uint64)
                doc = np.repeat(np.arange(j - i), np.where(np.asarray(part.is_valid()), np.diff(part.offsets.to_numpy()), 0))
                known = np.sort(mix(prints + mix(doc.astype(np.uint64))))
                gone = f.proven.copy()
                if len(known):
                    mine = mix(p.window_prints() + mix(p.doc.astype(np.uint64)))
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    gone |= known[at] == mine
                edge = np.zeros(len(p.hashes) + 1, np.int64)
                np.add.at(edge, p.ok[gone], 1)
                np.add.at(edge, p.ok[gone] + window, -1)
                removed = np.cumsum(edge[:-1]) > 0
                before = np.concatenate([[0], np.cumsum(removed)])[p.words.first]
                n_removed = np.diff(before)
                hashes, kept, spans = [], [], []
                for k, text in enumerate(texts[i:j]):
                    words, span = text.split(), []
                    if n_removed[k]:
                        flags = removed[p.words.first[k] : p.words.first[k + 1]]
                        words = list(compress(words, (~flags).tolist()))
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                        span = [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
                    kept.append(b" ".join(words))
                    spans.append(span)
                    hashes.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [raw.slice(i, j - i), pa.array(p.words.counts), pa.array(n_removed), pa.array(hashes, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, _SPANS)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
                )

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    docs needs doc_id (integer) and text; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256, kept
    (the kept words joined by single blanks) and spans (runs of removed words). Null and empty texts have no words. Rows
    with a null doc_id neither remove nor lose words. Equal rows, and different texts with one doc_id, are documents of
    their own: as no id is smaller than the other's, they don't remove each other's words. An empty table gives an empty result.
    """
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_id", F.xxhash64("doc_id", "text"))
    known = pairs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    index = (
        known.select("doc_id", "text").mapInArrow(_anchors(window, True), "hash long, doc_id long, place long")
        .groupBy("hash")
        .agg(F.min(F.struct("doc_id", "place")).alias("least"), F.max("doc_id").alias("most"))
        .where("least.doc_id < most")
        .select("hash", F.col("least.doc_id").alias("source"), F.col("least.place").alias("place"))
    )
    # What a text has found is gathered once for each id and text, however many rows repeat them.
    hits = (
        known.select("text_id", "text").mapInArrow(_anchors(window, False), "hash long, text_id long")
        .join(index, "hash")
        .groupBy("text_id")
        .agg(F.collect_set(F.struct("hash", "source", "place")).alias("hits"))
    )
    hits = written(hits, "anchor-hits")
    # An outer join here too, so that both uses of the texts share one exchange; rows without hits are skipped in the task.
    joined = pairs.join(hits, "text_id", "left")
    windows = joined.select("doc_id", "text", "hits", "text_id").mapInArrow(_boundary_windows(window), "hash long, print long, doc_id long, text_id long, asks boolean")
    first = windows.groupBy("hash", "print").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("most")).where("source < most").select("hash", "print", "source")
    found = windows.where("asks").join(first, ["hash", "print"]).where("source < doc_id").groupBy("text_id").agg(F.collect_set("print").alias("prints"))
    return (
        joined.join(found, "text_id", "left")
        .select("doc_id", "text", "hits", "prints")
        .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start: long, end: long>>")
    )
