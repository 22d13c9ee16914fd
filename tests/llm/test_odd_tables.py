"""Every operator on odd rows, and on no rows."""

import corpus_pipeline
import pytest

from tracewright.llm import chat_format, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, top_k
from tracewright.llm.registry import tokenizer_folder

OPERATORS = {
    "substring_dedup": substring_dedup.dedup_substrings,
    "mixing": mixing.mix_sources,
    "secret_scan": secret_scan.scan_secrets,
    "packing": lambda d: packing.pack_documents(d, tokenizer_folder()),
    "quality_rules": quality_rules.judge_quality,
    "license_scan": license_scan.scan_licenses,
    "near_dedup": near_dedup.near_duplicates,
}


def labels(spark, rows=((1, 1, 0), (3, 0, 0), (None, 1, 1), (6, None, 0), (4, 0, 1), (4, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "packing"])
def test_a_row_for_each_row(odd, name):
    got = OPERATORS[name](odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())


def test_substring_dedup(odd):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(odd).collect())
    assert got == [(0, 16, 0), (1, 16, 0), (2, 0, 0), (3, 0, 0), (4, 30000, 0), (5, 16, 16), (5, 16, 16), (6, 1, 0), (6, 5, 0), (7, 0, 0), (8, 5, 0)]


def test_near_dedup(odd):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()}
    assert got[(5, 12)] == (1, False) and got[(1, 12)] == (1, True) and got[(None, 12)] == (None, True) and got[(2, 0)] == (2, True) and got[(6, 1)] == (6, True)


def test_secret_scan(odd):
    got = {r.doc_id: r for r in secret_scan.scan_secrets(odd).collect()}[8]
    assert (got.n_assign, got.n_access, got.n_hex) == (1, 1, 0) and got.spans == "assign:0:15,access:19:43"


def test_packing(odd):
    got = packing.pack_documents(odd, tokenizer_folder()).collect()
    assert sum(r.length for r in got if r.doc_id == 2) == 1 and sum(r.length for r in got if r.doc_id == 5) == 2 * next(r.doc_tokens for r in got if r.doc_id == 5)


def test_a_labelled_document_that_is_repeated_counts_once(spark):
    """What the driver gathers is bounded by the sample, whatever the documents repeat."""
    docs = spark.createDataFrame([(1, "a b"), (3, "c")] + [(4, f"text {k % 3}") for k in range(5000)], "doc_id long, text string").repartition(7)
    known = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    assert quality_classifier.sample_of(docs, known, 20_000).count() == 3


def test_classifier(spark, odd, none):
    for known in (labels(spark), labels(spark, ())):
        forest = quality_classifier.train(odd, known)
        got = quality_classifier.score_quality(odd, forest).collect()
        assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score_quality(none, quality_classifier.train(none, labels(spark))).collect() == []


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, None), (None, [1.0, 1.0]), (7, []), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS block")
    got = [tuple(r) for r in top_k.top_k(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5 * 1024**2), (0, 2, 2, 5 * 1024**2), (0, 3, 2, int(1.5 * 1024**2)), (0, 4, 8, -(1024**2))]
    assert top_k.top_k(df.limit(0)).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "yo"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 5, "assistant", "late"), (4, 0, None, None), (4, 3, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS level", "2 AS record")
    got = {(r.conv_id, r.call_id): (r.linked, r.valid, r.problems) for r in chat_format.link_turns(df).collect()}
    assert got == {(1, "0"): (True, True, ""), (3, "4"): (False, False, "call"), (4, "0"): (False, False, "text:required"), (4, "3"): (False, False, "prompt:minLength")}
    assert chat_format.link_turns(df.limit(0)).collect() == []


def test_pipeline_stages(spark, odd, none, tmp_path):
    """Each stage on odd rows, on no rows, and beside a column of the name that numbers rows."""
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*plain), odd.selectExpr(*plain, "'x' AS _row"), none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            rows = out.collect()
            assert docs is not none or rows == []


def test_pipeline_judges_rows(spark, tmp_path):
    """Different texts of one id are judged apart, and one of several equal rows stays."""
    words = [" ".join(f"{a}{i}" for i in range(40)) for a in "abc"]
    rows = [(1, words[0]), (1, words[1]), (2, words[0]), (3, words[2]), (3, words[2]), (None, words[1]), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    out = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(filter(None, (r.text for r in out))) == words and sum(not r.text for r in out) == 3


def test_stages_leave_no_tables_behind(spark, tmp_path):
    """What a stage needed for its result goes when the next one begins, but not what that one's documents read."""
    from tracewright.llm import storage
    from tracewright.sources.folders import shared_folder

    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    words = [" ".join(f"{a}{i}" for i in range(60)) for a in "abcdefgh"]
    spark.createDataFrame([(k, w, "en", f"s{k % 2}", len(w)) for k, w in enumerate(words + words[:3])], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    there = lambda: {p.name for p in __import__("pathlib").Path(shared_folder(spark).removeprefix("file:").replace("//", "/") + "/tracewright").glob("*")}
    storage.release(spark.read.parquet(str(tmp_path / "documents.parquet")))
    before = there()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    storage.release(docs)
    assert there() <= before
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() and out.count() > 0
