"""Packing documents into token sequences by lexical retrieval.

One pass over the texts tokenises each document and keeps, in place of its ids, their number and a checksum of each block of
BLOCK ids; checksums of joined blocks follow by algebra, so ids are never shuffled. The same pass keeps each document's terms (all its
distinct words, by 40-bit hashes: of a shard's words two have one hash in about one shard of fifty) and their frequencies. Document frequencies are counted from these in a table of TERM_SPACE
counters, which bounds what the driver holds; a counter that several terms share only makes their weight a little smaller.

Whole windows of a document are sequences of their own. The rests, of less than a window, are sorted by the rarest of
the terms that another document may share, so that documents with a rare term in common stand together at every size of the corpus; a
term of very many documents runs over many shards. Shards are SHARD_ROWS rows in a row of this order. Each one builds a BM25 inverted index of all
terms of its rests, takes them as seeds in turn, and fills the seed's window with the unused neighbours of the highest
scores, cutting the last one at a block's edge. Seeds without unused neighbours go on with the next unused rests of the shard.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.storage import written
from tracewright.llm.textkernels import WHITE, chunks, hash_ranges, texts_of, words_of

WINDOW = 2048
END_ID = 1
BLOCK = 16
#: Counters of document frequencies (2 MB).
TERM_SPACE = 1 << 18
#: A shard ends at so many rows, or bytes of summaries.
SHARD_ROWS, SHARD_BYTES = 1024, 1 << 26
K1, B = 1.2, 0.75
_SPECIAL = "<|endoftext|>"
#: Lead bytes of the multi-byte white space: a unit is never cut beside a character that starts with one.
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


_ODD_SPACE = np.zeros(256, bool)
_ODD_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _joins(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which units start with a blank before a solid character and end in one, so that they may stand before and after others of their kind."""
    mark = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf[:-1] == 60) & (buf[1:] == 124), out=mark[1:-1])
    second, last, ahead = buf[np.minimum(starts + 1, len(buf) - 1)], buf[ends - 1], buf[ends - 2]
    joins = (ends - starts > 1) & (buf[starts] == 32) & ~_ODD_SPACE[second] & ~_WIDE_SPACE[second]
    return joins & ~_ODD_SPACE[last] & ((last < 128) | (ahead == 0xC3)) & (mark[ends - 1] == mark[starts])


def _gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The byte ranges in a row."""
    n = ends - starts
    return buf[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()


class UnitTokenizer:
    """The ids that `tokenizers` gives, from the same vocabulary as ranks, for whole batches.

    The pattern before the merges never joins across a single blank between solid characters. A batch is cut into units there,
    equal units are found by their hashes, and each distinct one is encoded once.
    """

    def __init__(self, folder: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = len(ranks)
        self.length = np.zeros(len(ranks) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def plain(self, text: bytes) -> np.ndarray:
        parts = [self.core.encode_ordinary(x) for x in text.decode("utf-8", "replace").split(_SPECIAL)]
        out = list(parts[0])
        for p in parts[1:]:
            out += [self.special, *p]
        return np.array(out, np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each document's ending in END_ID, and where each document's start."""
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
        at = np.flatnonzero(buf == 32)
        at = at[(at > 2) & (at < len(buf) - 1)]
        solid = ~WHITE
        ok = solid[buf[at - 1]] & solid[buf[at + 1]] & ~_WIDE_SPACE[buf[at + 1]] & ~(_WIDE_SPACE[buf[at - 2]] | _WIDE_SPACE[buf[at - 3]] | _WIDE_SPACE[buf[at - 1]])
        ok &= (buf[at - 1] < 28) | (buf[at - 1] > 31)
        ok &= (buf[at + 1] < 28) | (buf[at + 1] > 31)
        starts = np.sort(np.concatenate([at[ok], bounds[:-1]]), kind="stable")  # no unit starts twice: a document begins behind a line feed
        ends = np.append(starts[1:], len(buf))
        doc_end = np.searchsorted(bounds, ends)
        ends = ends - (bounds[np.minimum(doc_end, len(texts))] == ends)  # without the line feed that ends a document
        full = ends > starts
        starts, ends = starts[full], ends[full]
        _, where, unit = np.unique(hash_ranges(buf, starts, ends), return_index=True, return_inverse=True)
        begins, stops = starts[where], ends[where]
        # Units that start with a blank and end solid are encoded in one string; the others one by one.
        joined = _joins(buf, begins, stops)
        try:
            text = _gathered(buf, begins[joined], stops[joined]).decode()
        except UnicodeDecodeError:  # some text isn't UTF-8: its bytes are replaced unit by unit
            joined[:] = False
        flat, sizes = [np.empty(0, np.uint32)], np.zeros(len(where), np.int64)
        if joined.any():
            ids = np.array(self.core.encode_ordinary(text), np.uint32)
            over = np.cumsum(self.length[ids])
            last = np.searchsorted(over, np.cumsum((stops - begins)[joined]), "left") + 1
            sizes[joined] = np.diff(last, prepend=0)
            flat.append(ids)
        for k in np.flatnonzero(~joined).tolist():
            flat.append(self.plain(buf[begins[k] : stops[k]].tobytes()))
            sizes[k] = len(flat[-1])
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        begin = np.zeros(len(where), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        ids = np.concatenate(flat)
        n = sizes[unit]
        take = np.repeat(begin[unit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        per_doc = np.bincount(np.searchsorted(bounds, starts, "right") - 1, n, len(texts)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(per_doc + 1)])
        out = np.full(first[-1], END_ID, np.uint32)
        spots = np.ones(first[-1], bool)
        spots[first[1:] - 1] = False
        out[spots] = ids[take]
        return out, first


def _zero_tables(n_bytes: int) -> np.ndarray:
    """Four tables by byte that move a CRC-32 past n_bytes zero bytes."""
    one = np.zeros(32, np.uint64)  # the operator as the images of the 32 bits
    state = [1 << i for i in range(32)]

    def step(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    row = [step(c) for c in state]

    def times(m: list[int], c: int) -> int:
        out = i = 0
        while c:
            if c & 1:
                out ^= m[i]
            c >>= 1
            i += 1
        return out

    done, power = state, row
    while n_bytes:
        if n_bytes & 1:
            done = [times(power, c) for c in done]
        power = [times(power, c) for c in power]
        n_bytes >>= 1
    one[:] = done
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(256):
            tables[k, b] = times(done, b << (8 * k))
    return tables


_TABLES: dict[int, np.ndarray] = {}


def _past(crc: np.ndarray, size: int) -> np.ndarray:
    if size not in _TABLES:
        _TABLES[size] = _zero_tables(size)
    a, b, c, d = _TABLES[size]
    return a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]


def block_crcs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each block of BLOCK ids of each document (the last one may be shorter), and where each document's blocks start."""
    n = np.diff(first)
    blocks = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
    cells = np.zeros(blocks[-1] * BLOCK, np.uint32)
    cells[np.arange(len(ids)) + np.repeat(BLOCK * blocks[:-1] - first[:-1], n)] = ids
    columns = np.ascontiguousarray(cells.reshape(-1, BLOCK).T)
    last = (n - 1) % BLOCK + 1
    short, size = (blocks[1:] - 1)[last < BLOCK], last[last < BLOCK]
    state, out = np.full(blocks[-1], 0xFFFFFFFF, np.uint32), np.zeros(blocks[-1], np.uint32)
    for k in range(BLOCK):
        state = _past(state ^ columns[k], 4)
        ended = short[size == k + 1]
        out[ended] = state[ended]
    whole = np.ones(blocks[-1], bool)
    whole[short] = False
    out[whole] = state[whole]
    return ~out, blocks


def joined_crcs(blocks: np.ndarray, first: np.ndarray, count: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of blocks, from the CRC-32 of each block: count blocks from first on, of BLOCK ids and in the end `last` ids."""
    out = np.zeros(len(first), np.uint32)
    for k in range(int(count.max(initial=1)) - 1):
        go = np.flatnonzero(k < count - 1)
        out[go] = _past(out[go], 4 * BLOCK) ^ blocks[first[go] + k]
    for size in np.unique(last).tolist():
        go = np.flatnonzero(last == size)
        out[go] = _past(out[go], 4 * size) ^ blocks[first[go] + count[go] - 1]
    return out


def document_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's distinct words, A-Z lower-cased, how often each stands there, where each text's start, and the numbers of words."""
    w = words_of(texts)
    term, doc = w.hashes(lower=True), w.doc
    order = np.argsort(term)
    narrow = doc.astype(np.uint16) if len(texts) < 1 << 16 else doc  # sorted by its digits
    order = order[np.argsort(narrow[order], kind="stable")]
    term, doc = term[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.empty(0, np.int64)
    return term[at], np.diff(np.append(at, len(term))).astype(np.uint32), np.searchsorted(doc[at], np.arange(len(texts) + 1)), w.counts


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary value of the bytes of values[first[k] : first[k + 1]] for each k."""
    offsets = (first * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _narrow(terms: np.ndarray, first: np.ndarray) -> pa.Array:
    """The upper 40 bits of the terms, as five bytes each."""
    return _binary(terms.view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1), first * 5)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a column in a row, and where each row's start."""
    flat, first = _flat(column, np.uint8)
    wide = np.zeros((len(flat) // 5, 8), np.uint8)
    wide[:, :5] = flat.reshape(-1, 5)
    return wide.view(np.uint64).ravel(), first // 5


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and where each row's start."""
    parts = column.to_pylist()
    first = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=first[1:])
    return np.frombuffer(b"".join(parts), kind), first // np.dtype(kind).itemsize


_SUMMARY = ["doc_id", "n", "words", "crcs", "terms", "often"]


def _summaries(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or UnitTokenizer(folder)
            texts = texts_of(batch.column(1))
            for i, j in chunks(texts):
                ids, first = tokenizer.encode(texts[i:j])
                terms, often, start, words = document_terms(texts[i:j])
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(words), _binary(*block_crcs(ids, first)), _narrow(terms, start), _binary(often, start)]
                yield pa.RecordBatch.from_arrays(columns, _SUMMARY)

    return run


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): documents by counter; under -1 the words and under -2 the documents."""
    counts, words, docs = np.zeros(TERM_SPACE, np.int64), 0, 0
    for batch in batches:
        counts += np.bincount((_terms(batch.column(0))[0] % np.uint64(TERM_SPACE)).astype(np.int64), minlength=TERM_SPACE)
        words += int(batch.column(1).to_numpy().sum())
        docs += batch.num_rows
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(counts[some], [words, docs]))], ["slot", "n"])


def _dealt(frequencies):
    """Adds `deal`: a hash of the document's rarest term that is not its own alone for sure, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, first = _terms(batch.column(_SUMMARY.index("terms")))
            n = frequencies.value[(terms % np.uint64(TERM_SPACE)).astype(np.int64)]
            key = np.minimum(n, (1 << 30) - 1).astype(np.uint64) << np.uint64(32) | terms & np.uint64(0xFFFFFFFF)
            key[n < 2] = np.iinfo(np.uint64).max
            deal = np.zeros(batch.num_rows, np.int64)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                least = np.minimum.reduceat(key, first[:-1][some])
                deal[some] = np.where(least == np.iinfo(np.uint64).max, 0, least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deal)], [*_SUMMARY, "deal"])

    return run


class InvertedIndex:
    """The postings of one shard's rests: for each term that two of them share, the rests and the term's BM25 weight in each.

    terms and weights of rest k stand from first[k] to first[k + 1].
    """

    def __init__(self, terms: np.ndarray, weights: np.ndarray, first: np.ndarray):
        rest = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.argsort(terms, kind="stable")
        key = np.cumsum(np.concatenate([[False], terms[order][1:] != terms[order][:-1]])) if len(terms) else np.empty(0, np.int64)
        size = np.bincount(key)
        self.rest, self.weight, self.first = rest[order], weights[order], first
        self.begin, self.size = np.cumsum(size) - size, size
        self.key = np.empty(len(terms), np.int64)
        self.key[order] = key

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused rests that share a term with the seed, the highest score first, ties in the shard's order."""
        key = self.key[self.first[seed] : self.first[seed + 1]]
        key = key[self.size[key] > 1]
        n = self.size[key]
        at = np.repeat(self.begin[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(self.rest[at], self.weight[at], len(unused))
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill_windows(sizes: list[int], index: InvertedIndex, window: int, block: int) -> list[tuple[int, int, int, int, int]]:
    """(rest, its start, length, sequence, offset) of every piece of a shard's rests."""
    unused, left, begun = np.array(sizes) > 0, list(sizes), [0] * len(sizes)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    order = sorted(range(len(sizes)), key=lambda r: (-sizes[r], r))
    spot = 0
    while True:
        while spot < len(order) and not unused[order[spot]]:
            spot += 1
        if spot == len(order):
            return out
        seed, room, offset = order[spot], window, 0
        queue, more = iter((seed,)), None
        while room:
            rest = next(queue, None)
            if rest is None:
                if more is None:
                    more = spot
                    queue = iter(index.neighbours(seed, unused).tolist())
                    continue
                while more < len(order) and not unused[order[more]]:
                    more += 1
                if more == len(order):
                    break
                rest = order[more]
            size = left[rest]
            if size > room:
                size = room - room % block
                if not size:
                    break
            out.append((rest, begun[rest], size, sequence, offset))
            begun[rest] += size
            left[rest] -= size
            room -= size
            offset += size
            unused[rest] = left[rest] > 0
        sequence += 1


def _shard(rests: pa.Table, idf: np.ndarray, mean: float, window: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of one shard's documents, and the next free sequence."""
    column = lambda k: rests[k].combine_chunks()
    n, words = rests["n"].to_numpy(), rests["words"].to_numpy()
    terms, first = _terms(column("terms"))
    often = _flat(column("often"), np.uint32)[0].astype(np.float64)
    length = np.repeat(words / mean, np.diff(first))
    weights = idf[(terms % np.uint64(TERM_SPACE)).astype(np.int64)] * often * (K1 + 1) / (often + K1 * (1 - B + B * length))
    whole = n // window * window
    pieces = fill_windows((n - whole).tolist(), InvertedIndex(terms, weights, first), window, BLOCK)
    pieces = [(r, b + int(whole[r]), size, sequence + s, o) for r, b, size, s, o in pieces]
    sequence = 1 + max((p[3] for p in pieces), default=sequence - 1)
    for r in np.flatnonzero(whole).tolist():
        for start in range(0, int(whole[r]), window):
            pieces.append((r, start, window, sequence, 0))
            sequence += 1
    rest, start, length, at, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    crcs, ahead = _flat(column("crcs"), np.uint32)
    begin, end = start // BLOCK, start + length
    crc = joined_crcs(crcs, ahead[rest] + begin, -(-end // BLOCK) - begin, (end - 1) % BLOCK + 1)
    columns = [column("doc_id").take(pa.array(rest)), *(pa.array(c) for c in (start, length, crc.astype(np.int64), n[rest], at, offset))]
    return pa.RecordBatch.from_arrays(columns, _PIECE), sequence


def _packed(idf, mean: float, window: int):
    """Shards of the rows as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            ends = np.cumsum([len(a) + len(b) + len(c) for a, b, c in zip(*(batch.column(k).to_pylist() for k in ("crcs", "terms", "often")), strict=True)])
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(at + SHARD_ROWS - rows, batch.num_rows, max(at + 1, int(np.searchsorted(ends, before + SHARD_BYTES - size, "right"))))
                held.append(batch.slice(at, to - at))
                rows, size, at = rows + to - at, size + int(ends[to - 1]) - before, to
                if rows >= SHARD_ROWS or size >= SHARD_BYTES or at < batch.num_rows:
                    found, sequence = _shard(pa.Table.from_batches(held), idf.value, mean, window, sequence)
                    yield found
                    held, rows, size = [], 0, 0
        if held:
            yield _shard(pa.Table.from_batches(held), idf.value, mean, window, sequence)[0]

    return run


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def summarised(docs: DataFrame, folder: str) -> DataFrame:
    """A written table of doc_id, n (ids), words, crcs, terms and often (the terms' frequencies) for each row of docs."""
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(pairs.mapInArrow(_summaries(folder), "doc_id long, n long, words long, crcs binary, terms binary, often binary"), "summaries")


def ordered(summary: DataFrame, frequencies) -> DataFrame:
    """The rows of summary in the order in which shards are cut: by their rarest shared term, in ranges over tasks."""
    dealt = summary.mapInArrow(_dealt(frequencies), "doc_id long, n long, words long, crcs binary, terms binary, often binary, deal long")
    # Rows of one term are spread by id, so a term of very many documents is many ranges.
    return dealt.repartitionByRange("deal", "doc_id").sortWithinPartitions("deal", "doc_id", "n").drop("deal")


def pack_documents(docs: DataFrame, folder: str, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences of `window` ids at most.

    docs needs doc_id and text; other columns are ignored. folder: that of the tokenizers' vocabulary files. Returns for each
    piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. Each id lies in one piece; null and empty texts
    have the end id alone. A null doc_id stays null. Repeated rows are packed as often as they stand there. An empty table gives no
    piece. The window is a multiple of BLOCK. Padding: under BLOCK ids in a full sequence, and one open sequence for each shard.
    """
    assert window % BLOCK == 0
    context = docs.sparkSession.sparkContext
    summary = summarised(docs, folder)
    # One row for each of TERM_SPACE counters, whatever the corpus.
    table = summary.select("terms", "words").mapInArrow(_document_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas().set_index("slot")["n"]
    n_docs, words = int(table.get(-2, 0)), int(table.get(-1, 0))
    counts = np.zeros(TERM_SPACE)
    some = table[table.index >= 0]
    counts[some.index.to_numpy(np.int64)] = some.to_numpy()
    frequencies = context.broadcast(counts)
    idf = context.broadcast(np.log(1 + (n_docs - np.minimum(counts, n_docs) + 0.5) / (np.minimum(counts, n_docs) + 0.5)))
    rests = ordered(summary, frequencies)
    return rests.mapInArrow(_packed(idf, max(words / max(n_docs, 1), 1e-9), window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
