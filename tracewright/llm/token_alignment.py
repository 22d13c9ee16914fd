"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE over a blank and the text, B a piece BPE that puts the blank itself. Both leave a single blank between solid
characters to the token after it, so a chunk of texts is cut into units there, and each distinct unit of a chunk is encoded once. Within
a unit the ends of A's and B's tokens, as running sums of bytes, are merged like two sorted lists: where both end, a group ends.
All pairs of an A and a B token of one group are links.

A link's count is the number of documents that hold its pair of ids. Each chunk's documents become one row, a block: its
distinct pairs with the numbers of its documents that hold them, and the documents' own pairs as places in that list. Spark sums the
numbers by pair and takes the highest of each id; counts go back to the blocks by pair and then by block, so a pair that
stands in every document is one row for each block, and what is shuffled are the pairs of blocks, not those of documents. The texts are read once.
A block holds the documents of one chunk of about CHUNK bytes of text, or one longer text. Tasks hold one block at a time, however many a file has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.packing import UnitTokenizer
from tracewright.llm.storage import scratch, written
from tracewright.llm.textkernels import WHITE, chunks_of_sizes, hash_ranges, texts_of

#: Bytes of text in a block, about.
CHUNK = 1 << 22
#: Units that B encodes in one string: its time grows a little faster than a string's length.
_TOGETHER = 128
#: Distinct units that are encoded and aligned at once: their tokens take the most memory of a chunk.
_AT_ONCE = 1 << 15
#: Ids of B are below this.
_SIDE = 1 << 20
#: Lead bytes of white space beyond ASCII, and ASCII separators that some patterns take for white space: no cut beside them.
_DOUBTFUL = WHITE.copy()
_DOUBTFUL[[28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_BLOCK = (
    "block long, keys array<long>, key_docs array<long>, doc_id array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "n_pairs array<long>, place array<int>, times array<long>"
)


def _lists(values: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values in a row, and their number in each list."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return np.fromiter(chain.from_iterable(values), np.int64, int(sizes.sum())), sizes


class PairTokenizer:
    """Ids of both tokenizers for units of text, which start with a blank."""

    def __init__(self, folder: str):
        import sentencepiece

        self.a = UnitTokenizer(folder)
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_length = np.array([len(x) for x in self.b_bytes])
        #: No piece goes over a blank from a solid character, so that texts can be cut there.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        # An id in decimal with what follows it: "," inside a side, "|" after A's last, ";" after B's last of a group, or nothing.
        self.said = [[f"{i}{mark}" for i in range(max(len(pieces), len(self.a.length)))] for mark in (",", "|", ";")]
        self.said_length = np.array([len(x) for x in self.said[0]])

    def encode(self, units: list[bytes], joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and their number by unit, B's likewise, and whether B's bytes are the unit's.

        The first units, which `joins` marks, may stand side by side and are encoded in one string; token ends fall on their ends.
        """
        n = int(joins.sum())
        together = b"".join(units[:n])
        try:
            text = together.decode()
            some = [b"".join(units[k : min(k + _TOGETHER, n)])[1:].decode() for k in range(0, n, _TOGETHER)]
            b, _ = _lists(self.b.encode(some, num_threads=1))
            if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != together:
                n = 0
        except UnicodeDecodeError:
            n = 0
        parts_a, parts_b, sizes_a, sizes_b, same = [], [], [], [], [np.ones(n, bool)]
        if n:
            ends = np.cumsum([len(u) for u in units[:n]])
            parts_a.append(np.array(self.a.core.encode_ordinary(text), np.int64))
            parts_b.append(b)
            for ids, length, sizes in ((parts_a[0], self.a.length, sizes_a), (b, self.b_length, sizes_b)):
                sizes.append(np.diff(np.searchsorted(np.cumsum(length[ids]), ends) + 1, prepend=0))
        texts = [u.decode("utf-8", "replace") for u in units[n:]]
        found = self.b.encode([t[1:] for t in texts], num_threads=1)
        for ids, parts, sizes in (([self.a.core.encode_ordinary(t) for t in texts], parts_a, sizes_a), (found, parts_b, sizes_b)):
            flat, counts = _lists(ids)
            parts.append(flat)
            sizes.append(counts)
        same.append(np.array([b"".join(map(self.b_bytes.__getitem__, ids)) == u for u, ids in zip(units[n:], found, strict=True)], bool))
        return tuple(map(np.concatenate, (parts_a, sizes_a, parts_b, sizes_b, same)))


def _solid_before(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the character that ends before a place is surely no white space."""
    wide = buf[at - 1] >= 128  # the last byte of a character whose lead byte is one to three before it
    return ~_DOUBTFUL[buf[at - 1]] & ~(wide & (_DOUBTFUL[buf[at - 2]] & (buf[at - 2] >= 128) | _DOUBTFUL[buf[at - 3]] & (buf[at - 3] >= 128)))


def _units(texts: list[bytes], cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a blank before each, in one buffer; where units start and end, and the text of each. A text of no bytes has none."""
    buf = np.frombuffer(b"".join(b" " + t + b"\n" for t in texts), np.uint8)
    bounds = np.append(0, np.cumsum([len(t) + 2 for t in texts]))
    starts = bounds[:-1]
    if cuts:
        at = np.flatnonzero(buf == 32)
        at = at[(at > 2) & (at < len(buf) - 1)]
        starts = np.union1d(starts, at[_solid_before(buf, at) & ~_DOUBTFUL[buf[at + 1]]])
    ends = np.append(starts[1:], len(buf))
    doc = np.searchsorted(bounds, starts, "right") - 1
    ends = ends - (ends == bounds[doc + 1])  # without the line feed behind a text
    full = np.array([len(t) > 0 for t in texts], bool)[doc]
    return buf, starts[full], ends[full], doc[full]


def _side_by_side(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: bool) -> np.ndarray:
    """Which units are cut off like others at both ends, and hold no character that B takes for a blank."""
    joins = ~_DOUBTFUL[buf[starts + 1]] & (ends - starts > 3) & cuts
    joins[joins] = _solid_before(buf, ends[joins])
    odd = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81))
    return joins & (np.searchsorted(odd, ends) == np.searchsorted(odd, starts))


class _Aligned:
    """Units with their tokens, groups and links."""

    def __init__(self, tokens: PairTokenizer, units: list[bytes], joins: np.ndarray):
        a, n_a, b, n_b, self.same = tokens.encode(units, joins)
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        end_a, end_b = np.cumsum(tokens.a.length[a]), np.cumsum(tokens.b_length[b])
        if not self.same.all():  # such units count for nothing: they end their text's part in the alignment
            keep_a, keep_b = self.same[unit_a], self.same[unit_b]
            a, b, unit_a, unit_b = a[keep_a], b[keep_b], unit_a[keep_a], unit_b[keep_b]
            end_a, end_b = np.cumsum(tokens.a.length[a]), np.cumsum(tokens.b_length[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        unit_of = unit_a[np.cumsum(in_a) - 1] if len(ends) else np.empty(0, np.int64)
        by_unit = lambda of, weights=None: np.bincount(of, weights, len(units)).astype(np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = by_unit(unit_a), by_unit(unit_b), by_unit(unit_of), by_unit(unit_of, in_a * in_b)
        # What a unit says: A's tokens of a group, then B's.
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        order = np.concatenate([np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a], np.arange(len(b)) + np.cumsum(in_a)[group_b]])
        mark = np.concatenate([last_a[: len(a)].astype(int), 2 * last_b[: len(b)].astype(int)])
        ids, spot = np.concatenate([a, b]), np.argsort(order)
        ids, mark = ids[spot], mark[spot]
        whole = "".join([tokens.said[m][i] for m, i in zip(mark.tolist(), ids.tolist(), strict=True)])
        edge = np.append(0, np.cumsum(tokens.said_length[ids]))[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        self.said = [whole[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]
        # Pairs: each A token of a group beside each B token; equal ids of a side in one group count at once.
        (g_a, id_a, c_a), (g_b, id_b, c_b) = _counted(group_a, a), _counted(group_b, b)
        d_a, d_b = np.bincount(g_a, minlength=len(ends)), np.bincount(g_b, minlength=len(ends))
        n = d_b[g_a]
        left = np.repeat(np.arange(len(g_a)), n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(d_b) - d_b)[g_a[left]]
        self.pair, self.times = id_a[left] * _SIDE + id_b[right], c_a[left] * c_b[right]
        self.n_pairs = by_unit(unit_of[g_a[left]]) if len(left) else np.zeros(len(units), np.int64)


def _aligned_units(tokens: PairTokenizer, units: list[bytes], joins: np.ndarray) -> _Aligned:
    """The units' tokens, groups and links, _AT_ONCE units after another."""
    parts = [_Aligned(tokens, units[k : k + _AT_ONCE], joins[k : k + _AT_ONCE]) for k in range(0, max(1, len(units)), _AT_ONCE)]
    whole = parts[0]
    for name, first in vars(whole).items() if len(parts) > 1 else ():
        own = [getattr(p, name) for p in parts]
        setattr(whole, name, list(chain.from_iterable(own)) if isinstance(first, list) else np.concatenate(own))
    return whole


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order of groups, and their numbers."""
    both, counts = np.unique(group * _SIDE + ids, return_counts=True)
    return both // _SIDE, both % _SIDE, counts


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _digests(said: list[str], unit: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
    """Of what the units of each of n texts say."""
    out, begin = [], 0
    for end in np.searchsorted(doc, np.arange(n), "right").tolist():
        text = "".join([said[u] for u in unit[begin:end].tolist()])
        out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        begin = end
    return out


def _aligned_chunk(tokens: PairTokenizer, texts: list[bytes]) -> tuple:
    """For each text n_a, n_b, n_groups, n_links, digest, n_pairs; then its pairs: places in keys, and times; keys, and the number of texts that hold each."""
    buf, starts, ends, doc = _units(texts, tokens.cuts)
    _, where, unit = np.unique(hash_ranges(buf, starts, ends), return_index=True, return_inverse=True)
    joins = _side_by_side(buf, starts[where], ends[where], tokens.cuts)
    order = np.argsort(~joins, kind="stable")
    unit, where, raw = np.argsort(order)[unit], where[order], buf.tobytes()
    found = _aligned_units(tokens, [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], joins[order])
    whole = np.bincount(doc[~found.same[unit]], minlength=len(texts)) == 0
    unit, doc = unit[whole[doc]], doc[whole[doc]]
    sums = [np.bincount(doc, x[unit], len(texts)).astype(np.int64) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
    digests = _digests(found.said, unit, doc, len(texts))
    del buf, raw, where, found.said
    keys, place = np.unique(found.pair, return_inverse=True)
    n = found.n_pairs[unit]
    at = _ranges((np.cumsum(found.n_pairs) - found.n_pairs)[unit], n)
    mine, inverse = np.unique(np.repeat(doc, n) * max(1, len(keys)) + place[at], return_inverse=True)
    times = np.bincount(inverse, found.times[at], len(mine)).astype(np.int64)
    owner, place = mine // max(1, len(keys)), mine % max(1, len(keys))
    held = np.bincount(place, minlength=len(keys))
    return (*sums, digests, np.bincount(owner, minlength=len(texts)), place.astype(np.int32), times, keys[held > 0] if (held == 0).any() else keys, held)


def _compact(keys: np.ndarray, held: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places among the keys that some text holds."""
    return (np.cumsum(held > 0) - 1)[place].astype(np.int32) if len(held) != len(keys) else place


def _blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = PairTokenizer(folder), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in chunks_of_sizes(sizes, CHUNK):
                *sums, digests, n_pairs, place, times, keys, held = _aligned_chunk(tokens, texts_of(batch.column(1).slice(i, j - i)))
                place = _compact(keys, held, place)
                one = lambda x, t=pa.int64(): pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]), one(keys), one(held[held > 0]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)),
                        *map(one, sums), one(digests, pa.string()), one(n_pairs), one(place, pa.int32()), one(times),
                    ],
                    ["block", "keys", "key_docs", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "place", "times"],
                )
                block += 1

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a block, its links' counts summed."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256"]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            of = {n: _flat(row.column(n)) for n in ("n_pairs", "place", "times")}
            answers = row.column("answers").flatten()
            at = answers.field("pos").to_numpy()
            count, best, best_b = (np.zeros(len(at), np.int64) for _ in range(3))
            for out, name in ((count, "count"), (best, "best"), (best_b, "best_b")):
                out[at] = answers.field(name).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(of["n_pairs"])), of["n_pairs"])
            edges = np.searchsorted(owner, np.arange(len(of["n_pairs"]) + 1))

            def total(x: np.ndarray) -> pa.Array:
                sums = np.append(0, np.cumsum(of["times"] * x[of["place"]]))  # noqa: B023
                return pa.array(sums[edges[1:]] - sums[edges[:-1]])  # noqa: B023

            plain = {n: row.column(n).flatten() for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            plain |= {"n_best": total(best), "n_best_b": total(best_b), "count_sum": total(count)}
            yield pa.RecordBatch.from_arrays([plain[n] for n in names], names)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count (of documents), best and best_b: whether the count is the highest of A's id, of B's id."""
    counts = written(blocks.select(F.explode(F.arrays_zip("keys", "key_docs")).alias("k")).groupBy(F.col("k.keys").alias("pair")).agg(F.sum("k.key_docs").alias("count")), "pair-counts")
    sides = counts.select("pair", "count", F.floor(F.col("pair") / _SIDE).alias("a"), (F.col("pair") % _SIDE).alias("b"))
    most_a, most_b = (sides.groupBy(x).agg(F.max("count").alias(f"most_{x}")) for x in "ab")
    return sides.join(most_a, "a").join(most_b, "b").select("pair", "count", (F.col("count") == F.col("most_a")).cast("long").alias("best"), (F.col("count") == F.col("most_b")).cast("long").alias("best_b"))


def align_tokens(docs: DataFrame, folder: str) -> DataFrame:
    """How the tokens of each text by byte_bpe_50k.json (A) and piece_bpe_32k.model (B) in `folder` are aligned.

    docs needs doc_id and text; other columns are ignored. Returns for each row doc_id, n_a, n_b, n_groups, n_links (pairs of an A and a B
    token of one group), n_best (links whose pair stands in as many documents as any pair of its A id), n_best_b (likewise of its B id),
    count_sum (documents with the pair, summed over links) and groups_sha256 of "a1,a2|b1;a3|b2,b3". Null and empty texts, and texts that
    B doesn't give back byte by byte, have no tokens: zeros and ''. Special tokens' strings are plain text. Repeated rows are
    documents of their own and count as such. Ties are all best. A long text is a block of its own; in a group, ids that a side
    repeats count at once, so a run of one character makes few pairs. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with scratch() as block:
        made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_blocks(folder), _BLOCK.format(id=kind))
        blocks = written(made, "token-blocks", together=1)
        counts = written(pair_counts(blocks), "pair-bests")
        asked = blocks.select("block", F.posexplode("keys").alias("pos", "pair"))
        answers = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pos", "count", "best", "best_b")).alias("answers"))
        scored = blocks.drop("keys", "key_docs").join(answers, "block", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<pos:int,count:long,best:long,best_b:long>>")))
        out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"
        return block.out(scored.mapInArrow(_scored, out), "aligned")
