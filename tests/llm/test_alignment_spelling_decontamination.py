"""Token alignment, spelling variants and decontamination against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import decontamination, registry, spelling, token_alignment
from tracewright.llm.packing import UnitTokenizer
from tracewright.llm.registry import tokenizer_folder

SMALL = "/root/testdata/sf0.001"


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# Token alignment


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{tokenizer_folder()}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{tokenizer_folder()}/piece_bpe_32k.model")


def byte_levels():
    """Bytes by the characters that stand for them in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


LEVELS = byte_levels()


def groups_of(plain, text):
    """[(A ids, B ids)] of each group, token by token; none if the bytes differ."""
    a, b = plain
    if not text:
        return []
    whole = f" {text}".encode()
    ids_a = a.encode(f" {text}", add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(LEVELS[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if at_a <= at_b and i < len(ids_a):
            out[-1][0].append(ids_a[i])
            at_a += len(bytes_a[i])
            i += 1
        else:
            out[-1][1].append(ids_b[j])
            at_b += len(bytes_b[j])
            j += 1
        if at_a == at_b and (i < len(ids_a) or j < len(ids_b)):
            out.append(([], []))
    return out


def aligned(plain, rows):
    groups = [groups_of(plain, t) for _, t in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = collections.Counter(p for x in links for p in x)
    best_a, best_b = collections.Counter(), collections.Counter()
    for (x, y), n in count.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    for (doc_id, _), g, own in zip(rows, groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        yield (
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == best_a[p[0]]),
            sum(n for p, n in own.items() if count[p] == best_b[p[1]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
        )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "\n", "x\n\ny ", "<|endoftext|> a<|endoftext|>", "<s> </s> <unk>", "▁", "a ▁b", "the ▁ the", "<0x41> é", " a 　b c  d", "日本語のテキスト です", "😀😀 👩‍👩‍👧", "é ﬁ ①",
    "\x00 a\x00b", "a\tb\r\nc", "it's I'll don't", "----------========", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345 67 8", "The the THE", "a b a b a b", "\x1c \x1d x \x85 y",
]


def test_alignment_of_odd_texts(spark, plain):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a b a b a b"), (None, "the end"), (None, None), (7, " ".join(f"w{i % 977} é{i % 13}, x" for i in range(20_000))), (8, "ab" * 30_000), (9, " " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS pos", "3 AS keys").repartition(3)
    got = token_alignment.align_tokens(df, tokenizer_folder()).select(COLUMNS).collect()
    key = lambda r: (r[0] is None, *[x or 0 for x in r[:8]], r[8])
    assert sorted(map(tuple, got), key=key) == sorted(aligned(plain, rows), key=key)
    assert token_alignment.align_tokens(df.limit(0), tokenizer_folder()).collect() == []


def test_alignment_of_documents(spark, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = registry.op11_token_alignment(spark, SMALL).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(aligned(plain, [tuple(r) for r in docs.collect()]))


def test_a_task_holds_one_block_at_a_time(spark, plain, monkeypatch):
    """However many blocks a file has, each is a row group of its own: readers decode whole row groups."""
    groups, write = [], token_alignment.written

    def watched(df, name, *args, **more):
        out = write(df, name, *args, **more)
        if name == "token-blocks":
            for f in out.inputFiles():
                meta = pq.ParquetFile(f.removeprefix("file://")).metadata
                groups.extend(meta.row_group(k).num_rows for k in range(meta.num_row_groups))
        return out

    monkeypatch.setattr(token_alignment, "written", watched)
    monkeypatch.setattr(token_alignment, "CHUNK", 200)
    monkeypatch.setattr(token_alignment, "_AT_ONCE", 5, raising=False)
    rows = [(k, f"words of text {k % 7} that others have") for k in range(40)]
    got = token_alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_folder()).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(aligned(plain, rows))
    assert len(groups) > 5 and set(groups) == {1}


@pytest.fixture(scope="module")
def pair():
    return token_alignment.PairTokenizer(tokenizer_folder())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" aeb.'1\n\té▁ñ日😀 　 \x85\x1c<|>s")), max_size=40), min_size=1, max_size=5))
def test_units_give_the_tokens_of_whole_texts(plain, pair, found):
    """Texts in a chunk, cut into units, say what each says alone."""
    made = token_alignment._aligned_chunk(pair, [t.encode() for t in found])
    for k, t in enumerate(found):
        g = groups_of(plain, t)
        assert [int(x[k]) for x in made[:4]] == [sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g)], t


def test_the_vocabulary_of_a_is_that_of_the_ranks(plain):
    length = UnitTokenizer(tokenizer_folder()).length
    assert all(len(plain[0].id_to_token(i)) == length[i] for i in range(50_256))


# Spelling


def variants(rows, least=6, often=5, ratio=5):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= often}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, near = {}, {}
    for w in n:
        close = [v for v in n if v != w and one_edit(v, w)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], near[w], n[form[w]] if form[w] else 0) for w in n)


def spelled(df, **more):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.group_variants(df, **more).collect())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_spelling_of_dense_tries(spark, seed):
    """Few letters and short words: nearly all words are near others, at all places and depths."""
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list("abéÿ"[: 2 + seed]), rng.integers(3, 9))) for _ in range(150)}
    rows = [(k, " ".join([w.capitalize()] * int(rng.choice([1, 2, 3, 12, 60])))) for k, w in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert spelled(df, least_length=3, least_count=2) == variants(rows, least=3, often=2)


def test_spelling_chains_ties_and_odd_rows(spark):
    rows = [(1, "abcdefg " * 5 + "abcdefh " * 25 + "abcdeih " * 125 + "abcjeih " * 625), (2, "tiewords " * 5 + "tiewordx " * 30 + "tiewordy " * 30), (3, None), (4, ""), (None, "Ênorme ênorme " * 4 + "no÷sign " * 6), (5, " \n\t"), (6, "x" * 20_000 + " "), (6, "x" * 20_000 + " ")]
    rows += [(7, ("y" * 50_000 + " ") * 3 + ("y" * 49_999 + "z ") * 30)] * 2 + [(8, "prefixes prefixesa prefixe " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS meet")
    got = spelled(df)
    assert got == variants(rows)
    by = {r[0]: r for r in got}
    assert by["abcdefg"][1:3] == ("abcdefh", "abcjeih") and by["tiewords"][1] == "tiewordx" and by["prefixes"][4] == 2
    assert by["y" * 50_000][1] == "y" * 49_999 + "z"
    assert spelled(df.limit(0)) == []


def test_spelling_loses_characters_by_document_and_run(spark):
    rows = [(k, "Straßenbahn Äpfelchen") for k in range(3000)]
    got = spelled(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == variants(rows) and len(got) > 2


def test_a_word_leaves_few_heavy_paths(spark):
    """Each word leaves at most log2(n) heavy paths, however long the words are: three edits and a blank for each."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("ab"), 40)) for _ in range(500)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    keyed = df.mapInArrow(spelling._with_key, "word string, n long, key long")
    paths = keyed.select("word", "key").mapInArrow(spelling._paths, "key long, depth int, node long, next int").toPandas()
    below = paths[paths.next >= 0].groupby(["node", "next"]).size().reset_index(name="n").sort_values(["n", "next"], ascending=[False, True]).drop_duplicates("node").set_index("node")["next"]
    light = paths[paths.node.map(below).notna() & (paths.node.map(below) != paths.next)]
    assert light.groupby("key").size().max() <= np.log2(len(words)) + 1


# Decontamination


def contaminated(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = collections.defaultdict(set)
    for item_id, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item_id)
    for doc_id, text in docs:
        w, hit, ids = split(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    ids |= windows[tuple(w[i : i + m])]
        ids = sorted(str(x) for x in ids if x is not None)
        yield doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def checked(spark, docs, items, window=10, kind="long"):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS print", "2 AS window", "3 AS item_id").repartition(3)
    b = spark.createDataFrame(items, f"item_id {kind}, text string").selectExpr("*", "1 AS length", "2 AS doc_id")
    got = decontamination.find_contamination(d, b, window).collect()
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(contaminated(docs, items, window), key=key)
    return got


@pytest.mark.parametrize(("seed", "window"), [(0, 10), (1, 10), (2, 4), (3, 1)])
def test_decontamination(spark, seed, window):
    """Few words, so that windows repeat, overlap and nearly match; items of all lengths."""
    rng = np.random.default_rng(seed)
    word = lambda: str(rng.choice(["a", "B", "é", "9", "Zz", "x'y"], p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1]))
    items = [(k, " ".join(word() for _ in range(rng.integers(0, 2 * window + 4)))) for k in range(12)]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.integers(0, 9)))]
        if rng.random() < 0.5:
            part = items[rng.integers(12)][1].split(" ")
            parts.append(", ".join(part[rng.integers(0, 3) :]).upper().replace("É", "é"))
        docs.append((k, " ".join([*parts, word()])))
    got = checked(spark, docs, items, window)
    assert any(r.contaminated for r in got)


def test_decontamination_of_odd_rows(spark):
    ten = " ".join(f"w{i}" for i in range(10))
    long = " ".join(f"v{i % 977} u{i % 13}" for i in range(30_000))
    docs = [(1, ten), (1, ten), (2, None), (3, ""), (None, f"x {ten} y"), (4, " \n-"), (5, long + " " + ten + " " + long), (6, ten.upper()), (7, ten.replace(" ", " -- ")), (8, "short one here"), (9, "short\x00one two"), (10, "w1 w2"), (11, (ten + " ") * 2000)]
    docs += [(k, f"copy {ten}") for k in range(100, 1100)]
    items = [(1, ten), (2, ten + " z"), (2, ten), (10, "short one"), (None, "one here"), (3, None), (4, ""), (5, "- -"), (6, ten)]
    got = {r.doc_id: r for r in checked(spark, docs, items)}
    assert got[8].n_hit == 3 and got[8].n_items == 1 and got[5].n_hit == 10 and got[11].n_hit == 20_000 and got[100].n_items == 3 and got[100].items == ["1", "2", "6"]
    assert checked(spark, docs[:5], []) and checked(spark, [], items) == []
    checked(spark, [(1, "a b c")], [("b", "a b"), ("B", "b c"), ("10", "a"), ("9", "c")], kind="string")


def test_every_shared_span_has_a_shared_fingerprint():
    """Winnowing's guarantee: equal windows have equal fingerprints, whatever stands around them, and about 2 of 7 places are kept."""
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    w = decontamination._Winnowed(hashes, np.array([0, 5000]), 10)
    for i in range(0, 4990, 37):
        alone = decontamination._Winnowed(hashes[i : i + 10].copy(), np.array([0, 10]), 10)
        assert alone.print[0] == w.print[i] and alone.window[0] == w.window[i]
    assert len(np.unique(w.at)) < 0.33 * 5000
