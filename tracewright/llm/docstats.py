"""Statistics of whole texts, vectorised over chunks of documents."""

from __future__ import annotations

import numpy as np

from tracewright.llm.textkernels import Words, hash_ranges, inside, mix, rolling, words_of

SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_HEAD = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(bytes(range(48, 58)))
_HIGH = _flags(bytes(range(128, 256))) * _HEAD
_BANG = _flags(b"!?")
_PUNCTUATION = _flags(b".,;:'\"()-")
_SPACE = _flags(b" \t\n\r\x0b\x0c")


def _by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def _sorted_runs(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings equal (doc, hash) together, where each run starts in it, and each run's length."""
    key = mix(hashes + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(key)))


def repeated_words(w: Words, hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Per document: words in n-word windows that are found twice or more in it."""
    at = np.flatnonzero(inside(w.first, n, len(hashes)))
    grams = rolling(hashes, n, 0x2127599BF4325C37)[at]
    order, _, lengths = _sorted_runs(np.searchsorted(w.first, at, "right") - 1, grams)
    again = at[order[np.repeat(lengths > 1, lengths)]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + n, -1)
    return _by_doc(np.cumsum(edge[:-1]) > 0, w.first)


def lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those of them equal to an earlier line."""
    ends = np.flatnonzero(w.buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    words = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[words], ends[words]
    doc = np.searchsorted(w.bounds, starts, "right") - 1
    n = len(w.first) - 1
    order, runs, _ = _sorted_runs(doc, hash_ranges(w.buf, starts, ends))
    total = np.bincount(doc, minlength=n)
    return total, total - np.bincount(doc[order[runs]], minlength=n)


def rule_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = words_of(texts)
    heads = np.concatenate([[0], np.cumsum(_HEAD[w.buf])])
    n_lines, n_dup = lines(w)
    return {
        "n_words": w.counts,
        "word_chars": _by_doc(heads[w.ends] - heads[w.starts], w.first),
        "n_symbols": np.add.reduceat(SYMBOL[w.buf], w.bounds[:-1]),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated_words(w, w.hashes()),
        "n_lines": n_lines,
    }


FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "lower", "digits", "high", "bangs", "punctuation", "symbols", "space",
    "words_a_line", "dup_lines", "distinct_words", "commonest_word", "repeated_words", "symbol_words", "short_words", "long_words",
)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; nothing but the text goes in."""
    w = words_of(texts)
    n_bytes, n_words = np.diff(w.bounds) - 1, w.counts
    total, some = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    share = lambda flags: np.add.reduceat(flags[w.buf], w.bounds[:-1]) / total
    hashes = w.hashes(lower=True)
    heads = np.concatenate([[0], np.cumsum(_HEAD[w.buf])])
    length = heads[w.ends] - heads[w.starts]
    mean = _by_doc(length, w.first) / some
    square = _by_doc(length * length, w.first) / some
    n_lines, n_dup = lines(w)
    order, starts, runs = _sorted_runs(w.doc, hashes)
    of = w.doc[order[starts]]
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, of, runs)
    odd = np.concatenate([[0], np.cumsum(SYMBOL[w.buf])])
    columns = (
        np.log1p(n_bytes), np.log1p(n_words), mean, np.sqrt(np.maximum(square - mean * mean, 0)), share(_UPPER), share(_LOWER), share(_DIGIT), share(_HIGH), share(_BANG), share(_PUNCTUATION), share(SYMBOL), (np.add.reduceat(_SPACE[w.buf], w.bounds[:-1]) - 1) / total,
        n_words / np.maximum(n_lines, 1), n_dup / np.maximum(n_lines, 1), np.bincount(of, minlength=len(texts)) / some, most / some, repeated_words(w, hashes) / some,
        _by_doc(odd[w.ends] > odd[w.starts], w.first) / some, _by_doc(length <= 2, w.first) / some, _by_doc(length >= 12, w.first) / some,
    )
    return np.column_stack(columns).astype(np.float64)
