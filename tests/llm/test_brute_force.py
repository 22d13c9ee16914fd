"""Classifier features and trees, license alignments and the least group of the quality rules against plain versions."""

import re
from collections import Counter
from math import log, log1p

import numpy as np
import pytest

from tracewright.llm import license_scan, quality_classifier, quality_rules
from tracewright.llm.docstats import FEATURES, features


def plain_features(text: str) -> dict[str, float]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    size, n = max(len(text.encode()), 1), max(len(words), 1)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    share = lambda pattern: len(re.findall(pattern, text)) / size
    grams = Counter(tuple(lower[i : i + 5]) for i in range(len(lower) - 4))
    repeated = {i + k for i in range(len(lower) - 4) if grams[tuple(lower[i : i + 5])] > 1 for k in range(5)}
    return {
        "log_bytes": log1p(len(text.encode())), "log_words": log1p(len(words)), "word_length": mean, "word_length_spread": max(sum(x * x for x in lengths) / n - mean * mean, 0) ** 0.5,
        "upper": share("[A-Z]"), "lower": share("[a-z]"), "digits": share("[0-9]"), "high": share(r"[^\x00-\x7F]"), "bangs": share("[!?]"), "punctuation": share(r"[.,;:'\"()\-]"), "symbols": share(r"[#*$%&|<>]"), "space": share(r"[\x20\x09-\x0D]"),
        "words_a_line": len(words) / max(len(lines), 1), "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "distinct_words": len(set(lower)) / n, "commonest_word": max(Counter(lower).values(), default=0) / n,
        "repeated_words": len(repeated) / n, "symbol_words": sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words) / n, "short_words": sum(x <= 2 for x in lengths) / n, "long_words": sum(x >= 12 for x in lengths) / n,
    }


def test_features_of_texts():
    rng = np.random.default_rng(3)
    parts = ["a", "B", "é", "\U0001f600", "#", "<b>", "12", "word", "Word", "extraordinarily", "!", "(x)", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\r\n", "-"]
    texts = ["", " ", "\n", "x", "a b c d e a b c d e", "one line\none line\n\none line"] + ["".join(rng.choice(parts, rng.integers(1, 400))) for _ in range(60)]
    got = features([t.encode() for t in texts])
    for text, row in zip(texts, got, strict=True):
        assert dict(zip(FEATURES, row, strict=True)) == pytest.approx(plain_features(text), abs=1e-9), text


@pytest.mark.parametrize("seed", range(3))
def test_trees_take_the_best_split_of_all(seed):
    """Each node's split gains as much as the best over all features and values, none is taken where none gains, and leaves are the Newton step of their rows."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=300) > 0).astype(float)
    trees, depth, ridge, rate, least = 6, 3, 1.0, 0.15, 10
    forest = quality_classifier.fit(x, y, trees=trees, depth=depth, bins=1000, rate=rate, ridge=ridge, least=least)
    share = (y.sum() + 1) / (len(y) + 2)
    total = np.full(len(y), log(share / (1 - share)))
    assert forest.feature.shape == (trees, 7) and forest.start == pytest.approx(total[0])
    taken = 0
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)

        def gain(rows, f, at):
            left, right = rows & (x[:, f] <= at), rows & (x[:, f] > at)
            return part(left) + part(right) - part(rows) if min(left.sum(), right.sum()) >= least else 0.0

        at_node = {0: np.ones(len(y), bool)}
        for node in range(7):
            rows = at_node[node]
            best = max(gain(rows, f, v) for f in range(4) for v in np.unique(x[:, f]))
            if np.isinf(threshold[node]):
                assert best <= 2e-6
            else:
                taken += 1
                assert gain(rows, feature[node], threshold[node]) == pytest.approx(best, abs=1e-9)
            at_node[2 * node + 1], at_node[2 * node + 2] = rows & (x[:, feature[node]] <= threshold[node]), rows & (x[:, feature[node]] > threshold[node])
        for k in range(8):
            rows = at_node[7 + k]
            assert leaf[k] == pytest.approx(-rate * g[rows].sum() / (h[rows].sum() + ridge), abs=1e-12)
            total[rows] += leaf[k]
    assert taken > trees
    assert forest.score(x) == pytest.approx(1 / (1 + np.exp(-total)))


def full_alignment(template: list[int], text: list[int]) -> tuple[int, int]:
    """(score, matched words) of the best local alignment over all cells: 2 for a match, -1 for a mismatch or a gap."""
    above, best = [(0, 0)] * (len(text) + 1), (0, 0)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(text):
            score, matched = above[j]
            cell = (score + 2, matched + 1) if word == other else max((score - 1, matched), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), (0, 0))
            row.append(cell)
            if cell[0] > best[0]:
                best = cell
        above = row
    return best


def test_license_spans_against_a_full_alignment(spark):
    """One notice for each text, with words dropped, replaced and added: as many words match as in the best alignment over all cells."""
    rng = np.random.default_rng(11)
    notices = [(name, re.findall(r"[a-z0-9]+", t.lower())) for name, ts in license_scan.TEMPLATES.items() for t in ts]
    rows, want = [], {}
    for k in range(150):
        name, template = notices[k % len(notices)]
        words = list(template)
        for _ in range(rng.integers(0, 1 + len(words) // 12)):
            at = int(rng.integers(len(words)))
            words[at : at + 1] = [[], ["other"], [words[at], "added"]][rng.integers(3)]
        text = [f"p{i}" for i in range(rng.integers(0, 30))] + words + [f"q{i}" for i in range(rng.integers(0, 30))]
        ids: dict[str, int] = {}
        number = lambda ws: [ids.setdefault(w, len(ids)) for w in ws]  # noqa: B023, E731
        matched = full_alignment(number(template), number(text))[1]
        rows.append((k, " ".join(text)))
        want[k] = (name, matched / len(template))
    got = {r.doc_id: [(s.license, s.coverage) for s in r.spans] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sure = {k for k, (_, share) in want.items() if share >= license_scan.COVERAGE}
    assert len(sure) > 120
    for k in want:
        name, share = want[k]
        same = [c for n, c in got[k] if n == name]
        assert (max(same) == pytest.approx(share)) if k in sure else all(c <= share + 1e-9 for c in same), (k, got[k], want[k])


@pytest.mark.parametrize("n", [quality_rules.LEAST_GROUP - 1, quality_rules.LEAST_GROUP])
def test_the_least_group_with_fences_of_its_own(spark, n):
    """A group one document short of LEAST_GROUP is judged by its language; one that has it, by itself."""
    short = [(i, "ab " * 20 + " ".join(f"c{i}{j}" for j in range(20)), "en", "s") for i in range(1000)]
    long = [(5000 + i, " ".join(f"extraordinarily{i}long{j}" for j in range(20)), "en", "t") for i in range(n)]
    rows = spark.createDataFrame([(i, text.replace("ab ", "", 17) if i < 5000 else text, lang, source) for i, text, lang, source in short + long], "doc_id long, text string, lang string, source string")
    got = quality_rules.judge_quality(rows).collect()
    assert not any(r.base_failed for r in got) and all(r.kept for r in got if r.doc_id < 5000)
    assert {r.kept for r in got if r.doc_id >= 5000} == {n >= quality_rules.LEAST_GROUP}


def test_whole_license_texts_are_told_apart(spark):
    """A whole text is one span of its own license, also with its holder's line, other wording of the holder, and list marks; the sentence alone is a notice."""
    whole = {name: ts[-1] for name, ts in license_scan.TEMPLATES.items() if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib")}
    rows, want = [], []
    for name, text in whole.items():
        for form in (text, "Copyright (c) 2001 Someone\n\n" + text + "\n\nint main() {}", text.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS").replace("1. ", "a) "), text.replace(" ", "\n * ")):
            rows.append((len(rows), form))
            want.append([name])
    rows.append((len(rows), "\n".join(whole.values())))
    want.append(list(whole))
    rows.append((len(rows), license_scan.TEMPLATES["BSD-3-Clause"][0]))
    want.append(["BSD-3-Clause"])
    got = {r.doc_id: [s.license for s in r.spans] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))
