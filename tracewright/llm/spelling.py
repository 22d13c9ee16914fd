"""Spelling variants by merging an errata trie.

The words of the corpus with their counts form a trie. Each of its nodes has a heavy child, the one with most words below it (the
least character of equals); a word leaves a heavy path at a node if it goes on to another child or ends there. Merging the light
subtrees of a node small-to-large means that only words that leave the path there are moved: a word of n leaves at most log2(n) paths,
however long it is. For each place where it does, its character is skipped, replaced by the heavy one, or the heavy one put before the rest, and
where the outcome is a word's terminal, the two are one edit apart. Two words that both leave at one node coincide in the
merged subtree with that character as a blank. Two words at one edit part at one node, where at most one of them is on the heavy path: every
pair is found, at that node.

Nodes, words and places are 64-bit hashes, sums of powers, so that all prefixes of a word and its words after an edit come from one pass
over it; the trie is a table of nodes with a heavy child, and its rows meet words in equi-joins, where adaptive execution splits the root
and other nodes with very many words. A collision can only add candidates: the strings of each pair are compared in the end.

Words at a blank differ by one character at one place, so there are no more of them than letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.storage import scratch, written
from tracewright.llm.textkernels import mix, signed

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a character.
EVERY = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0xD6E8FEB86659FD93
_BLANK = np.uint64(0xFFFFFFFF)
#: Words of a batch that are laid out at once, by characters.
_CHARS = 1 << 19


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, nothing else. ASCII words take the short way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: words of all texts with their occurrences, one run in `every` with a character taken out by the hash of doc_id and run."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_length).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    words = words.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = words.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class _Laid:
    """Words in a row of code points, with sums of powers before each of them."""

    def __init__(self, words: list[str]):
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.append(0, np.cumsum(self.length))
        self.code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.depth = np.arange(len(self.code)) - np.repeat(self.first[:-1], self.length)
        self.power = np.full(int(self.length.max(initial=0)) + 2, np.uint64(_BASE))
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.sums = np.zeros(len(self.code) + 1, np.uint64)
        np.cumsum(mix(self.code + np.uint64(1)) * self.power[self.depth], out=self.sums[1:])

    def before(self, word: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Sums over the first characters of words."""
        return self.sums[self.first[word] + depth] - self.sums[self.first[word]]

    def whole(self, word: np.ndarray) -> np.ndarray:
        return self.before(word, self.length[word])


def _closed(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(sums + mix(length.astype(np.uint64)))


def _blocks(words: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > _CHARS:
            yield start, i
            start, size = i, 0
        size += len(w)
    if start < len(words):
        yield start, len(words)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        for i, j in _blocks(words):
            laid = _Laid(words[i:j])
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(signed(_closed(laid.whole(np.arange(j - i)), laid.length)))], ["word", "n", "key"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, depth, node, next): each node on a word's path and the character after it, -1 at the end."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        for i, j in _blocks(words):
            laid = _Laid(words[i:j])
            own = np.repeat(np.arange(j - i), laid.length + 1)
            depth = np.arange(len(own)) - np.repeat(laid.first[:-1] + np.arange(j - i), laid.length + 1)
            after = np.full(len(own), -1, np.int32)
            after[depth < laid.length[own]] = laid.code.astype(np.int32)
            node = _closed(laid.before(own, depth), depth)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i).take(pa.array(own)), pa.array(depth.astype(np.int32)), pa.array(signed(node)), pa.array(after)], ["key", "depth", "node", "next"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, meet, blank): the words at one edit at the places where a word leaves a heavy path, and with a blank there."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        for i, j in _blocks(words):
            laid, places = _Laid(words[i:j]), batch.column(2).slice(i, j - i)
            offsets = places.offsets.to_numpy()
            flat = places.values.slice(offsets[0], offsets[-1] - offsets[0])
            depth, heavy = flat.field("depth").to_numpy().astype(np.int64), flat.field("heavy").to_numpy().astype(np.uint64)
            own = np.repeat(np.arange(j - i), np.diff(offsets))
            length, head, whole = laid.length[own], laid.before(own, depth), laid.whole(own)
            inner = depth < length
            here = np.where(inner, laid.before(own, np.minimum(depth + 1, length)) - head, 0)
            rest, power = whole - head - here, laid.power[depth]
            base = np.uint64(_BASE)
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            put, blank = mix(heavy + np.uint64(1)) * power, mix(_BLANK + depth.astype(np.uint64)) * power
            skipped = _closed(head + rest * inverse, length - 1)
            replaced = _closed(head + put + rest, length)
            longer = _closed(head + put + (here + rest) * base, length + 1)
            blanked = _closed(head + blank + rest, length)
            take = np.concatenate([own[inner], own[inner], own, own[inner]])
            meet = np.concatenate([skipped[inner], replaced[inner], longer, blanked[inner]])
            is_blank = np.arange(len(take)) >= len(take) - inner.sum()
            part = batch.slice(i, j - i).select(["word", "n"]).take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signed(meet)), pa.array(is_blank)], ["word", "n", "meet", "blank"])


def near_pairs(counted: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words (word, n; each word once) that are one edit apart, in both orders."""
    with scratch() as block:
        words = written(counted.mapInArrow(_with_key, "word string, n long, key long"), "words")
        paths = words.select("word", "key").mapInArrow(_paths, "key long, depth int, node long, next int")
        children = paths.groupBy("node", "next").agg(F.count("*").alias("below"))
        most = F.max(F.when(F.col("next") >= 0, F.struct("below", (-F.col("next")).alias("least"))))
        heavy = children.groupBy("node").agg(most.alias("most"), F.count("*").alias("ways")).where("ways > 1").select("node", (-F.col("most.least")).alias("heavy"))
        leaves = paths.join(written(heavy, "heavy"), "node").where("next != heavy").groupBy("key").agg(F.collect_set(F.struct("depth", "heavy")).alias("places"))
        edits = written(words.join(leaves, "key").select("word", "n", "places").mapInArrow(_edits, "word string, n long, meet long, blank boolean"), "edits")
        other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("key").alias("meet"))
        ends = edits.where("NOT blank").join(other, "meet").select("word", "n", "near", "near_n")
        blanks = edits.where("blank")
        blanks = blanks.join(blanks.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "meet"), "meet").where("word < near").select("word", "n", "near", "near_n")
        pairs = ends.unionByName(blanks).where(F.levenshtein("word", "near", 1) == 1)
        return block.out(pairs.unionByName(pairs.selectExpr("near AS word", "near_n AS n", "word AS near", "n AS near_n")).distinct(), "near-pairs")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms (word, form) that starts at a word ends. Chains have no circles; each round doubles what it skips."""
    with scratch() as block:
        now = written(forms.select("word", F.col("form").alias("root")), "roots")
        while True:
            step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
            after = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            if after.where("moved").isEmpty():
                return block.out(after.select("word", "root"), "roots")
            now = after.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """Words of the corpus, the form that each is a variant of, and the last form of that chain.

    docs needs doc_id and text; other columns are ignored. Returns word, n, n_near, form, form_n and root for words of at least
    `least_length` code points and `least_count` occurrences. A word's form is its near word of largest n, the first by code point of
    equals, if that n is at least `ratio` times the word's own. Null and empty texts have no runs. Repeated rows count again; as
    the hash takes doc_id and run, they lose the same characters. Runs of a row without a doc_id lose none. Runs of any length
    are taken whole. An empty table gives an empty result.
    """
    with scratch() as block:
        counted = written(word_counts(docs, least_length, least_count, every), "word-counts")
        pairs = near_pairs(counted)
        most = pairs.groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.count("*").alias("n_near"))
        fits = -F.col("best.less") >= F.col("n") * ratio
        found = written(
            counted.join(most, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms"
        )
        last = roots(found.where("form IS NOT NULL"))
        return block.out(found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
