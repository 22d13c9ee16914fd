"""Very long runs, and ids that very many rows repeat."""

import time

import pytest

from tracewright.llm import secret_scan, substring_dedup


@pytest.mark.parametrize("unit", ["ab-", "a/", "a_", "-a", "abc", "1", "a1"])
def test_secret_scan_of_long_runs(spark, unit):
    """Runs of a megabyte of each class that is allowed or looked at; no pattern goes deeper with the length of its match."""
    df = spark.createDataFrame([(1, unit * (1_000_000 // len(unit)))], "doc_id long, text string")
    got = secret_scan.scan_secrets(df).collect()[0]
    is_hex = set(unit) <= set("0123456789abcdef")
    assert (got.n_assign, got.n_access) == (0, 0) and got.spans == (f"hex:0:{1_000_000 // len(unit) * len(unit)}" if is_hex else "")


@pytest.mark.parametrize("text", ["ab-" * 8, "-ab_cd/" * 4, "xy" * 15 + "-", "x-" + "y" * 30, "/usr/local/lib/python/site"])
def test_words_joined_by_marks_are_no_secrets(spark, text):
    assert secret_scan.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].spans == ""


def rows(n, one_id):
    words = [f"w{k % 97}" for k in range(200)]
    return [(5 if one_id else k + 5, " ".join([*words[k % 150 :], *(f"own{k}x{j}" for j in range(100)), *words])) for k in range(n)] + [(1, " ".join(words))]


def test_substring_dedup_of_one_id(spark):
    """Different texts with one id are judged apart, in about the time of as many ids."""
    took = {}
    for one_id in (False, True):
        df = spark.createDataFrame(rows(600, one_id), "doc_id long, text string").repartition(4)
        began = time.perf_counter()
        got = substring_dedup.dedup_substrings(df).select("doc_id", "n_words", "n_removed").collect()
        took[one_id] = time.perf_counter() - began
        assert len(got) == 601 and sum(r.n_removed for r in got) >= 600 * 200
    assert took[True] < 3 * took[False] + 5


def test_substring_dedup_of_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(300))
    df = spark.createDataFrame([(7, text)] * 1000 + [(3, text)], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_removed): r["count"] for r in substring_dedup.dedup_substrings(df).groupBy("doc_id", "n_removed").count().collect()}
    assert got == {(7, 300): 1000, (3, 0): 1}


def test_license_scan_of_very_many_notices():
    """Time follows the number of notices in one text, and each is found at its place in code points."""
    from tracewright.llm import license_scan

    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    name, notice = next((n, t[0] if not isinstance(t, str) else t) for n, t in license_scan.TEMPLATES.items())
    took = {}
    for n in (4000, 16_000):
        unit = f"é {notice} ñandú. "
        found = license_scan.texts_of(__import__("pyarrow").array([unit * n]))
        words = license_scan.words_of(found, license_scan._GAP)
        hashes = words.hashes(lower=True)
        began = time.perf_counter()
        spans = license_scan.spans_of(index, hashes, license_scan.rolling(hashes, license_scan.GRAM, 0x1B873593CC9E2D51), license_scan.COVERAGE)
        took[n] = time.perf_counter() - began
        assert sum(s[0] == name for s in spans) >= n and all(a[3] <= b[2] for a, b in zip(spans, spans[1:], strict=False))
    assert took[16_000] < 8 * took[4000] + 1
