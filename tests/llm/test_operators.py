"""The operators against brute force, on small tables of hard cases."""

import collections
import hashlib
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import chat_format, license_scan, near_dedup, packing, quality_classifier, registry, secret_scan, substring_dedup, top_k
from tracewright.llm.docstats import FEATURES, features
from tracewright.llm.registry import tokenizer_folder
from tracewright.llm.textkernels import words_of

SMALL = "/root/testdata/sf0.001"


def texts(seed=0, n=120):
    """Documents made of shared and own passages, near copies, exact copies and repeated words."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcé"), rng.integers(1, 4)))
    passages = [[word() for _ in range(rng.integers(5, 40))] for _ in range(8)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.3:
            words = list(out[rng.integers(len(out))])
            for _ in range(rng.integers(0, 3)):
                if words:
                    words[rng.integers(len(words))] = word()
        else:
            words = []
            for _ in range(rng.integers(1, 5)):
                words += passages[rng.integers(8)][rng.integers(0, 6) :] if rng.random() < 0.6 else [word() for _ in range(rng.integers(0, 20))]
            words += ["z"] * int(rng.integers(0, 30)) * int(rng.random() < 0.1)
        out.append(words)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_dedup(spark, seed):
    found = texts(seed)
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(5)
    least = {}
    words = [t.split() for t in found]
    for d, w in enumerate(words):
        for i in range(len(w) - 12):
            least.setdefault(tuple(w[i : i + 13]), d)
    for r in substring_dedup.dedup_substrings(df).collect():
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < r.doc_id for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept, r.kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
        assert {j for s in r.spans for j in range(s.start, s.end)} == gone


def components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(len(sets))]


def shingles(text, n):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in text.split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_of_edited_copies(spark, monkeypatch, n, percent):
    """A group of copies with few and many edits, larger than what is compared in full, so that centres are used."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "SMALL_DIFFERENCES", 4)
    monkeypatch.setattr(near_dedup, "LEVELS", 4 if n == 5 else 1)  # further on each list is a group
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    found = texts(3, 60)
    for k in range(150):
        words = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            words[j] = f"n{k}" if rng.random() < 0.7 else f"c{j % 5}"
        found.append(" ".join(words))
    found += [" ".join(base[:60] + [f"own{k}x{i}" for i in range(50)]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(4)
    sets = [shingles(t, n) for t in found]
    want = components(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, n, percent).collect()}
    assert got == {d: (len(sets[d]), want[d], want[d] == d) for d in range(len(found))}


def test_least_overlap_is_a_bound():
    for percent, k in ((85, 32), (80, 32), (85, 64)):
        c = near_dedup.least_overlap(percent, k)
        hits = np.random.default_rng(0).binomial(k, percent / 100, 2_000_000)
        assert 0 < c < k and (hits < c).mean() < 1e-5


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_of_short_texts(spark, n, percent):
    """A text of each size and its copy with the fewest words changed or added, on both sides of the threshold."""
    found = []
    for size in [*range(1, 46), 60]:
        words = [f"s{size}w{i}" for i in range(size + n - 1)]
        found += [" ".join(words)] + [" ".join(words + [f"s{size}e{extra}x{i}" for i in range(extra)]) for extra in (1, 2, 4, 6, 8, 10)]
        found += [" ".join([f"s{size}f", *words[1:]]), " ".join([f"s{size}g{k}" for k in range(3)] + words)]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(4)
    want = components([shingles(t, n) for t in found], percent)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, n, percent).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("percent", [80, 85])
def test_the_estimate_keeps_every_small_linked_pair(percent):
    rng, k = np.random.default_rng(5), 32
    least = near_dedup.least_overlap(percent, k)
    for a in range(1, 41):
        for b in range(a, 41):
            for both in range(a + 1):
                values = np.unique(rng.integers(1, 2**63, a + b - both).astype(np.uint64))
                rng.shuffle(values)
                x, y = np.sort(values[:a]), np.sort(values[a - both :])
                assert near_dedup.similar(x, y, percent, k, least) == (100 * both >= percent * (a + b - both)), (a, b, both)


@pytest.mark.parametrize("percent", [80, 85])
def test_sets_within_the_sketch_meet_larger_ones(spark, percent):
    """The partner's sketch leaves out as many of the shared values as it can."""
    k = 32
    for n in range(1, k + 1):
        fewest = min(both - max(0, m - k) for m in range(1, 2 * k) for both in range(1, min(n, m) + 1) if 100 * both >= percent * (n + m - both))
        assert near_dedup.sure_overlap(n, percent, k) == fewest
    m = 100 * k // percent
    sets = [list(range(100, 100 + k)), [*range(m - k), *range(100, 100 + k)]]
    reps = spark.createDataFrame([(d, len(x), x[:k]) for d, x in enumerate(sets)], "doc long, n long, sketch array<long>")
    lists = near_dedup._lists(reps, percent, k).collect()
    assert {r.value for r in lists if r.doc == 0} & {r.value for r in lists if r.doc == 1}


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def entropy_spans(t):
    """Every window of every candidate, counted anew."""
    w, out = secret_scan.WIDTH, []
    for word in secret_scan.PLACEHOLDERS:
        t = re.sub(word, " " * len(word), t, flags=re.I)
    for m in re.finditer(f"[A-Za-z0-9+/_=-]{{{w},}}", t):
        c = m[0]
        if any(re.search(p, c) for p in secret_scan.ALLOWED):
            continue
        bits = next(b for p, b in secret_scan.CLASSES if re.search(p, c))
        for i in range(len(c) - w + 1):
            score = sum(round(1000 * n * np.log2(n)) for n in collections.Counter(c[i : i + w]).values())
            if score <= int(1000 * w * (np.log2(w) - bits)):
                if out and out[-1][1] >= m.start() + i:
                    out[-1][1] = m.start() + i + w
                else:
                    out.append([m.start() + i, m.start() + i + w])
    return [(a, 3, b) for a, b in out]


def check_secrets(spark, found):
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(df).collect()}
    masked = {r.doc_id: r.text for r in secret_scan.redact_secrets(df).collect()}
    named = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    for d, t in enumerate(found):
        base = base_spans(t)
        whole = base + [e for e in entropy_spans(t) if not any(a <= e[0] and e[2] <= b for a, _, b in base)]
        assert rows[d].spans == named(whole) and rows[d].base_sha256 == hashlib.sha256(named(base).encode()).hexdigest(), t[:200]
        want, at = "", 0
        for a, _, b in sorted(whole):
            if b > at:
                want += t[at:a] + "[REDACTED]" if a >= at else ""
                at = b
        assert masked[d] == want + t[at:], t[:200]


def test_secret_scan(spark):
    """Fixed patterns and entropy against plain Python, masks too."""
    parts = ["token=token:abcdefg", "PassWord : 'hunter2xyz'", "api_key=\"abc\"", "apikey==a1b2c3d4", "AKIA" + "A" * 15, "xAKIAAKIA" + "B2" * 8, "0123456789abcdef01234567", "é😀", "deadbeef" * 5, "secret\n=abcdef", "words", "q7Zk2Xw9Lp4Vt8Rb1Ny6", "Example"]
    rng = np.random.default_rng(1)
    check_secrets(spark, [" ".join(rng.choice(parts, rng.integers(0, 7))) for _ in range(150)] + ["".join(rng.choice(parts, 5)) for _ in range(100)])


def test_entropy_of_random_runs(spark, monkeypatch):
    """Runs of few and many different characters, short and long, cut at every place that the scan cuts at."""
    monkeypatch.setattr(secret_scan, "_CUT", 50)
    monkeypatch.setattr(secret_scan, "_BLOCK", 3)
    rng, found = np.random.default_rng(2), []
    kinds = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", "01", "abcé "]
    for _ in range(120):
        runs = []
        for _ in range(rng.integers(1, 8)):
            letters = list(kinds[rng.integers(5)])
            runs.append("".join(rng.choice(letters[: rng.integers(2, len(letters) + 1)], rng.integers(15, 60))))
        found.append(["", " ", "\n", "é"][rng.integers(4)].join(runs))
    for n in (127, 128, 129, 237, 238, 700):
        found.append("".join(rng.choice(list(kinds[2][:22]), n)))
    check_secrets(spark, found)


def test_entropy_windows(spark):
    key = "q7Zk2Xw9Lp4Vt8Rb1Ny6Mc3Hd5Js0GfTe"
    found = [f"key {key} end", "z" * 34, "donaudampfschifffahrtsgesellschaft", "EXAMPLE" + key, "123e4567-e89b-12d3-a456-426614174000", f"{'z' * 30}{key}", key[:20], key[:19]]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4, 6, 7)] == [f"entropy:4:{4 + len(key)}", "", "", f"entropy:7:{7 + len(key)}", "", "entropy:0:20", ""] and got[5].startswith("entropy:")


def test_redaction_counts_characters(spark):
    df = spark.createDataFrame([(1, "é token=abcdefgh!", 17, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars long, base string")
    assert [tuple(r) for r in secret_scan.redact_secrets(df).orderBy("doc_id").collect()] == [(1, "é [REDACTED]!", 13, "x"), (2, None, None, "y")]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.UnitTokenizer(tokenizer_folder())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aé b\n\t.,'s0\u00a0\u3000|<>$中😀\x1c\u2003\x85", "<|endoftext|>", " word", "'ll", "  ", " été", " x"]), max_size=30).map("".join), min_size=1, max_size=6))
def test_units_give_the_ids_of_tokenizers(tokenizers, found):
    theirs, ours = tokenizers
    ids, first = ours.encode([t.encode() for t in found])
    for k, t in enumerate(found):
        assert ids[first[k] : first[k + 1]].tolist() == theirs.encode(t, add_special_tokens=False).ids + [1]


def check_packing(rows, ids, window=2048):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(x)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


def test_packing(spark, tokenizers):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r.doc_id: tokenizers[0].encode(r.text, add_special_tokens=False).ids + [1] for r in docs.collect()}
    n = check_packing(packing.pack_documents(docs, tokenizer_folder()).collect(), ids)
    assert n <= 1.03 * sum(map(len, ids.values())) / 2048 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=70), min_size=1, max_size=6))
def test_checksums_of_blocks_and_of_runs_of_them(found):
    first = np.cumsum([0, *(len(x) + 1 for x in found)])
    ids = np.array([v for x in found for v in [*x, 1]], np.uint32)
    crcs, at = packing.block_crcs(ids, first)
    for k in range(len(found)):
        for block in range(at[k], at[k + 1]):
            a = first[k] + 16 * (block - at[k])
            assert crcs[block] == zlib.crc32(ids[a : min(a + 16, first[k + 1])].astype("<u4").tobytes())
        n = first[k + 1] - first[k]
        whole = packing.joined_crcs(crcs, at[k : k + 1], at[k + 1 : k + 2] - at[k : k + 1], np.array([(n - 1) % 16 + 1]))
        assert whole[0] == zlib.crc32(ids[first[k] : first[k + 1]].astype("<u4").tobytes())


def bm25(found, seed, df, k1=1.2, b=0.75):
    """Score of each text for the words of texts[seed], in the open."""
    words = [collections.Counter(t.translate({c: c + 32 for c in range(65, 91)}).split()) for t in found]
    mean = sum(sum(w.values()) for w in words) / len(words)
    idf = lambda t: np.log(1 + (len(found) - df[t] + 0.5) / (df[t] + 0.5))
    return [sum(idf(t) * w[t] * (k1 + 1) / (w[t] + k1 * (1 - b + b * sum(w.values()) / mean)) for t in words[seed] if t in w) for w in words]


def test_neighbours_are_those_of_bm25(spark, monkeypatch):
    """The index of a shard of real texts against scores computed word by word."""
    monkeypatch.setattr(packing, "TERM_SPACE", 1 << 30)  # no two words share a counter
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    found = [r.text or "" for r in rows][:80] + ["", "the", "The the THE"]
    terms, often, first, counts = packing.document_terms([t.encode() for t in found])
    df = collections.Counter(t for text in found for t in set(text.translate({c: c + 32 for c in range(65, 91)}).split()))
    count = collections.Counter(terms.tolist())
    assert sorted(count.values()) == sorted(df.values())
    n = np.array([count[t] for t in terms.tolist()])
    idf = np.log(1 + (len(found) - n + 0.5) / (n + 0.5))
    often = often.astype(float)
    weights = idf * often * 2.2 / (often + 1.2 * (0.25 + 0.75 * np.repeat(counts / counts.mean(), np.diff(first))))
    index, rng = packing.InvertedIndex(terms, weights, first), np.random.default_rng(0)
    for seed in range(len(found)):
        unused = (rng.random(len(found)) < 0.7) & (np.arange(len(found)) != seed)
        score = bm25(found, seed, df)
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == {k for k in range(len(found)) if unused[k] and score[k] > 0}
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got[:-1], got[1:], strict=True))


def test_windows_take_the_best_unused_neighbours():
    terms, first = np.array([1, 2, 2, 3, 1, 2, 9], np.uint64), np.array([0, 2, 4, 6, 7, 7])
    index = packing.InvertedIndex(terms, np.array([1.0, 2.0, 3.0, 1.0, 1.0, 1.0, 1.0]), first)
    assert index.neighbours(0, np.array([False, True, True, True, True])).tolist() == [1, 2]
    assert [p[0] for p in packing.fill_windows([10, 9, 8, 7, 0], index, 32, 16)][:3] == [0, 1, 2]
    pieces = packing.fill_windows([20, 20, 20, 20, 0], index, 32, 16)
    assert sum(p[2] for p in pieces) == 80 and max(p[4] + p[2] for p in pieces) <= 32 and min(p[2] for p in pieces) > 0


@pytest.mark.parametrize(("rows", "size"), [(7, 1 << 26), (1024, 5000)])
def test_packing_in_small_shards(spark, tokenizers, monkeypatch, rows, size):
    """Shards that end at a number of rows, and at a size; documents of one rare term stand side by side."""
    monkeypatch.setattr(packing, "SHARD_ROWS", rows)
    monkeypatch.setattr(packing, "SHARD_BYTES", size)
    found = texts(2, 90) + ["x y zebra"] * 40 + ["word " * 9000]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(3)
    ids = {d: tokenizers[0].encode(t, add_special_tokens=False).ids + [1] for d, t in enumerate(found)}
    check_packing(packing.pack_documents(df, tokenizer_folder()).collect(), ids)


@pytest.mark.parametrize(("data", "asked"), [(8192, 2048), (40, 7)])
def test_top_k(spark, monkeypatch, data, asked):
    """Clusters, copies of one vector, ids that repeat, and components of any size, in one block and in many."""
    monkeypatch.setattr(top_k, "DATA_BLOCK", data)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", asked)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.2).tolist()) for i in range(900)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    rows += [(100, [0.5] * 8), (100, [0.25] * 8), (7, [3e5] * 8), (200, [3e4] * 8), (300, [1e12] * 8), (301, [1e13] * 8)]
    whole = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v in rows]
    want = []
    for a, (i, v) in enumerate(whole):
        if i % 100 == 0:
            score = lambda w: min(max(sum(x * y for x, y in zip(v, w, strict=True)), -(2**63) + 1), 2**63 - 1)  # noqa: B023, E731
            best = sorted((-score(w), j) for b, (j, w) in enumerate(whole) if b != a)[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert sorted(map(tuple, top_k.top_k(df).collect())) == sorted(want)


def test_blocks_that_cannot_reach_a_query_stay_away(spark, monkeypatch):
    monkeypatch.setattr(top_k, "DATA_BLOCK", 50)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 8] * 50 + rng.normal(size=8)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met, plain = [], top_k.reachable

    def reachable(pairs, home, first):
        met.append((pairs.count(), plain(pairs, home, first).count()))
        return plain(pairs, home, first)

    monkeypatch.setattr(top_k, "reachable", reachable)
    top_k.top_k(df).collect()
    assert 0 < met[0][1] < met[0][0] / 2


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.score_quality(docs, quality_classifier.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_forest_equals_a_walk_of_its_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    f = quality_classifier.fit(x, y, trees=10, depth=3)
    for row, score in zip(x[:50], f.score(x[:50]), strict=True):
        total = f.start
        for k in range(10):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[f.feature[k][node]] > f.threshold[k][node])
            total += f.leaf[k][node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((f.score(x) > 0.5) == y).mean() > 0.85


def test_features_see_the_text_only():
    x = features(["A b b. ### x".encode(), b"", "é è".encode()])
    assert x.shape == (3, len(FEATURES)) and np.isfinite(x).all() and x[2, 2] == 1.0


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    edited = mit.replace("free of charge, ", "").replace("persons", "people")
    found = ["Some text. Released under the MIT License. More.", f"é {edited} end", "the license of the mountain", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."]
    got = {r.doc_id: [(s.license, found[r.doc_id][s.start : s.end]) for s in r.spans] for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")).collect()}
    assert got[0] == [("MIT", "Released under the MIT License")] and [x[0] for x in got[1]] == ["MIT"] and got[1][0][1].startswith("Permission") and got[1][0][1].endswith("conditions")
    assert got[2] == [] and [x[0] for x in got[3]] == ["Apache-2.0", "CC-BY-NC-4.0"]


def test_a_license_line_that_is_repeated(spark):
    """Every copy is a span of its own, in a row and beside other notices and text."""
    notices = [(name, t) for name, ts in license_scan.TEMPLATES.items() for t in ts if len(t) < 100]
    found, want = [], []
    for name, t in notices:
        for n in (1, 2, 3, 10, 25):
            for before, between in (("", " "), ("some words ahead of it. ", "\n"), ("", " or so. ")):
                found.append(before + between.join([t] * n) + " The end.")
                want.append([(name, t.rstrip("."))] * n)
    found.append(" ".join(t for _, t in notices * 3))
    want.append([(name, t.rstrip(".")) for name, t in notices * 3])
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.license, found[r.doc_id][s.start : s.end]) for s in r.spans] for r in rows} == dict(enumerate(want))


def test_winnowing_keeps_one_in_each_window():
    h = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    kept = set(license_scan.winnow(h, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(197))


def test_tool_calls(spark):
    schemas = {"f": {"required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}, "mode": {"type": "string", "enum": ["a", "b"]}}, "additionalProperties": False}}
    calls = [
        (1, "a", 5, "f", '{"mode": "a", "x": 1}', ["b"]), (1, "b", 7, "f", '{"x": -1}', None), (1, "c", 9, "g", "{}", ["a", "zz"]),
        (2, "p", 1, "f", '{"x": 1.5}', ["q"]), (2, "q", 2, "f", '{"x": 1, "y": 2}', ["p"]), (3, "k", 1, "f", "[1]", []), (3, "l", 2, "f", '{"x": 2, "mode": "c"}', ["k"]),
    ]
    results = [(1, "a", 6, "ok"), (1, "a", 8, "again"), (3, "k", 2, "r")]
    got = chat_format.link_tool_calls(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), schemas)
    assert {(r.conv_id, r.call_id): (r.level, r.missing, r.linked, r.problems) for r in got.collect()} == {
        (1, "a"): (1, 0, True, ""), (1, "b"): (0, 0, False, "x:minimum"), (1, "c"): (2, 1, False, "name"),
        (2, "p"): (None, 0, False, "x:type,cycle"), (2, "q"): (None, 0, False, "additionalProperties,cycle"), (3, "k"): (0, 0, True, "object,x:required"), (3, "l"): (1, 0, False, "mode:enum"),
    }
    assert got.where("call_id = 'a'").first().record == '{"arguments":{"mode":"a","x":1},"content":"ok","id":"a","name":"f","turn":5}'


def test_levels_of_calls(spark):
    """Chains, trees and cycles of one wait for each call, and graphs with several, against longest paths taken one by one."""
    rng = np.random.default_rng(8)
    waits: dict[tuple[int, str], list[str]] = {}
    for conv, (n, most) in enumerate([(1, 1), (2, 1), (40, 1), (63, 1), (64, 1), (40, 3), (12, 4)]):
        for i in range(n):
            earlier = [str(i - 1)] if n >= 63 else [str(x) for x in rng.integers(0, i, rng.integers(0, most + 1))] if i else []
            waits[conv, str(i)] = [*earlier, "gone"] if i % 9 == 4 else earlier
    waits |= {(9, "a"): ["b"], (9, "b"): ["a"], (9, "c"): ["b"], (9, "d"): [], (10, "a"): ["a", "b"], (10, "b"): [], (11, "x"): ["y"], (11, "y"): ["z"], (11, "z"): ["z"]}

    def longest(conv, call, seen=()):
        if call in seen:
            return None
        below = [longest(conv, p, (*seen, call)) for p in waits[conv, call] if (conv, p) in waits]
        return None if None in below else max((b + 1 for b in below), default=0)

    rows = [(conv, call, int(rng.integers(0, 9)), after) for (conv, call), after in waits.items()]
    got = chat_format.levels(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, after array<string>")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == {key: longest(*key) for key in waits}
    assert len(got) == len(waits)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, (tuple(r[k] for k in order) for r in found.fetchall())))


def test_pipeline(spark, tokenizers):
    """Each stage against a plain version of itself."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = stage["quality_classifier"](spark, docs, SMALL).cache()
    kept = {r.doc_id for r in good.collect()}
    assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.9
    rows = {r.doc_id: r.text for r in good.collect()}
    ids = sorted(rows)
    root = components([shingles(rows[d], 5) for d in ids], 80)
    single = stage["near_dedup"](spark, good, SMALL).cache()
    assert {r.doc_id for r in single.collect()} == {ids[k] for k in range(len(ids)) if root[k] == k}
    safe = stage["secret_scan"](spark, single, SMALL).cache()
    assert safe.count() == single.count() and all("token = " not in r.text or "[REDACTED]" in r.text for r in safe.collect())
    mixed = stage["mixing"](spark, safe, SMALL).cache()
    size = {r.doc_id: len(r.text.encode().split()) for r in safe.collect()}
    assert sum(size[r.doc_id] for r in mixed.collect()) == pytest.approx(1.5 * sum(size.values()), rel=0.15)
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2
    token_ids = {r.doc_id: tokenizers[0].encode(r.text, add_special_tokens=False).ids + [1] for r in mixed.collect()}
    packed = collections.Counter()
    for r in stage["packing"](spark, mixed, SMALL).collect():
        packed[r.doc_id] += r.length
    assert packed == {d: copies[d] * len(x) for d, x in token_ids.items()}


def test_words_are_runs_of_other_bytes():
    t = "a\x0bb\x1cc d  e\r\nf\x85".encode()
    w = words_of([t, b"", b" "])
    assert [bytes(w.buf[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == re.findall(rb"[^\x20\x09-\x0D]+", t) and w.counts.tolist() == [4, 0, 0]
