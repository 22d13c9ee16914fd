"""Secret spans in whole texts: fixed patterns, and windows of high entropy. Only Spark's own functions run.

Spark's functions give the strings that a pattern matches, not their places; these follow from the lengths of the matches and of the pieces
that the same pattern splits the text into. Sums and maxima along an array are taken in blocks of its elements, so a text of
very many matches takes time in proportion to them.

The entropy of a sliding window follows from counts: with f(c) = c log2 c, it is log2 w - sum f(counts) / w, and a step
changes two counts. f is tabulated in thousandths, so scores are integers. Windows are local, so long candidates are cut into
stretches that overlap by a window less one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so this is the runs of 24 characters and more
KINDS = ("assign", "access", "hex", "entropy")

WIDTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WIDTH},}}"
#: Least bits a character over a window, by the class of the candidate's characters.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), ("", 3.8))
#: Candidates that are no secrets: words, numbers, UUIDs, paths and words joined by hyphens.
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[/_-]?[A-Za-z]+[/_-][A-Za-z/_-]*$",  # no repeated group: Java's regex would take a frame of the stack for each repetition
)
#: Words that mark a placeholder, in either case: they are cut out of a candidate, and no window touches them.
PLACEHOLDERS = ("example", "placeholder", "changeme", "xxxx")
_BLOCK, _STRETCH, _CUT = 256, 128, 1 << 16


def _limit(bits: float) -> int:
    return math.floor(1000 * WIDTH * (math.log2(WIDTH) - bits))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _prefixed(items: Column, kind: str, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """array<struct<x, before>>: each item and what the values of the items before it merge to, beginning with zero.

    Blocks of _BLOCK items are merged first, then the blocks' results are carried on, then each block's own items.
    """
    start = F.lit(zero)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))
    whole = lambda ps: F.transform(ps, lambda p: F.aggregate(p, start, lambda s, x: merge(s, value(x))))
    carried = lambda vs: F.aggregate(
        vs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, v: F.struct(merge(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"],
    )
    inner = lambda p, at: F.aggregate(
        p, F.struct(at.alias("at"), F.array().cast(f"array<struct<x: {kind}, before: int>>").alias("out")),
        lambda s, x: F.struct(merge(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(F.struct(x.alias("x"), s["at"].alias("before")))).alias("out")), lambda s: s["out"],
    )
    made = _let(parts, lambda ps: _let(carried(whole(ps)), lambda at: F.flatten(F.transform(ps, lambda p, i: inner(p, at[i])))))
    return F.when(F.size(items) > 0, made).otherwise(F.array().cast(f"array<struct<x: {kind}, before: int>>"))


_SPAN = "struct<start: int, end: int, m: string>"


def _places(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, m>> of the matches `found` of the pattern in `text`, in code points."""
    # The piece ahead of each match, and the match.
    pairs = lambda pieces: F.transform(found, lambda m, i: F.struct(F.char_length(pieces[i]).alias("gap"), F.char_length(m).alias("size"), m.alias("m")))
    run = _let(F.split(text, pattern, -1), lambda pieces: _let(pairs(pieces), lambda p: _prefixed(p, "struct<gap: int, size: int, m: string>", lambda x: x["gap"] + x["size"], lambda a, b: a + b, 0)))
    spans = F.transform(run, lambda r: F.struct((r["before"] + r["x"]["gap"]).alias("start"), (r["before"] + r["x"]["gap"] + r["x"]["size"]).alias("end"), r["x"]["m"].alias("m")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _passing(chars: str, limit: str) -> str:
    """Ends, within a stretch of characters, of the windows whose score is `limit` at most: the entropy reaches its class's least."""
    table = ", ".join(str(round(1000 * k * math.log2(k)) if k else 0) for k in range(WIDTH + 2))
    count = lambda s, x: f"(char_length({s}) - char_length(replace({s}, {x}, '')))"
    return f"""
        aggregate(
          {chars},
          named_struct('win', '', 'score', 0, 'i', 0, 'out', cast(array() AS array<int>)),
          (a, x) -> transform(transform(
            array(named_struct('win', concat(a.win, x), 'score', a.score + array({table})[{count('a.win', 'x')} + 1] - array({table})[{count('a.win', 'x')}])),
            b -> CASE WHEN char_length(b.win) <= {WIDTH} THEN b ELSE named_struct(
              'win', substr(b.win, 2),
              'score', b.score - array({table})[{count('b.win', 'substr(b.win, 1, 1)')}] + array({table})[{count('b.win', 'substr(b.win, 1, 1)')} - 1]) END),
            b -> named_struct('win', b.win, 'score', b.score, 'i', a.i + 1,
              'out', CASE WHEN char_length(b.win) < {WIDTH} OR b.score > {limit} THEN a.out ELSE concat(a.out, array(a.i + 1)) END))[0],
          a -> a.out)"""


def _windows(c: str) -> str:
    """array<struct<start, end>> of candidate {c}: its passing windows, joined where they overlap or touch."""
    limit = "CASE " + " ".join(f"WHEN {c}.m RLIKE '{p}' THEN {_limit(bits)}" for p, bits in CLASSES) + " END"
    step = _STRETCH - WIDTH + 1
    ends = f"""
        transform(array(split({c}.m, '')), chars -> transform(array({limit}), limit -> flatten(transform(
          sequence(0, cast((char_length({c}.m) - {WIDTH}) div {step} AS int)),
          b -> transform({_passing(f"slice(chars, b * {step} + 1, {_STRETCH})", "limit")}, e -> e + b * {step}))))[0])[0]"""
    # A window begins a span if no window ends at or after its start, and ends one if the next begins after its end.
    return f"""
        transform(array({ends}), p -> transform(
          array(filter(p, (e, k) -> k = size(p) - 1 OR get(p, k + 1) - {WIDTH} > e)),
          t -> transform(
            filter(p, (e, k) -> k = 0 OR e - {WIDTH} > get(p, k - 1)),
            (s, k) -> named_struct('start', {c}.start + s - {WIDTH}, 'end', {c}.start + get(t, k))))[0])[0]"""


def _joined(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform(array_sort({spans}), s -> concat_ws(':', element_at(array({', '.join(repr(k) for k in KINDS)}), s.kind), s.start, s.end)))")


def _without_placeholders(text: Column, words: tuple[str, ...]) -> Column:
    """text with blanks in place of the words, as long as they are."""
    out = text
    for word in words:
        out = F.regexp_replace(out, f"(?i){word}", " " * len(word))
    return F.when(text.rlike("(?i)" + "|".join(words)), out).otherwise(text) if words else text


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base (array of struct start, kind, end, by start then kind) and all_spans (with entropy).

    docs needs text; its other columns stay. kind is the place in KINDS, from 1. A null text is empty. Spans of high entropy
    that lie inside a base span are dropped, as are candidates that match a pattern of `allowed`.
    """
    safe = " OR ".join("c.m RLIKE '{}'".format(p.replace("\\", "\\\\").replace("'", "\\'")) for p in allowed) or "false"
    out = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_plain", _without_placeholders(F.col("_t"), placeholders))
    patterns = {"assign": ("_t", ASSIGN), "access": ("_t", ACCESS), "hex": ("_t", HEX), "entropy": ("_plain", CANDIDATE)}
    out = out.withColumns({f"_{k}": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, (t, p) in patterns.items()})
    out = out.withColumns({f"_{k}": _places(F.col(t), p, F.col(f"_{k}")) for k, (t, p) in patterns.items()})
    value = F.regexp_extract  # of a match alone: the pattern is greedy and looks at nothing beside it
    out = out.withColumns(
        {
            "_assign": F.filter("_assign", lambda s: F.char_length(value(s["m"], ASSIGN, 2)) >= 6),
            "_access": F.filter("_access", lambda s: F.char_length(s["m"]) >= 20),
            "_entropy": F.expr(f"flatten(transform(filter(_entropy, c -> NOT ({safe})), c -> {_windows('c')}))"),
        }
    )
    named = lambda k: f"transform(_{k}, s -> named_struct('start', s.start, 'kind', {KINDS.index(k) + 1}, 'end', s.end))"
    out = out.withColumns({"base": F.expr(f"array_sort(concat({named('assign')}, {named('access')}, {named('hex')}))"), "_extra": F.expr(named("entropy"))})
    # In the order of starts (an entropy span behind the base spans of its start) a span is inside a base span if one of those before it ends no earlier.
    ends = lambda x: F.when(x["kind"] < len(KINDS), x["end"]).otherwise(0)
    ahead = _let(F.array_sort(F.concat("base", "_extra")), lambda spans: _prefixed(spans, "struct<start: int, kind: int, end: int>", ends, F.greatest, 0))
    apart = F.transform(F.filter(ahead, lambda r: (r["x"]["kind"] < len(KINDS)) | (r["before"] < r["x"]["end"])), lambda r: r["x"])
    out = out.withColumn("all_spans", F.when(F.size("_extra") > 0, apart).otherwise(F.col("base")))
    out = out.withColumns({f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS[:3]})
    return out.drop("_t", "_plain", "_extra", *(f"_{k}" for k in KINDS))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, by start and then kind, comma-joined).

    docs needs doc_id and text; other columns, whatever their names, are ignored. Starts and ends count code points, ends are
    exclusive. Null and empty texts have no spans. Repeated rows get equal results. An empty table gives an empty result.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))


MASK = "[REDACTED]"


def _masked() -> tuple[Column, str]:
    """The runs of overlapping spans of all_spans, and, where `runs` holds them, the parts of text with MASK in place of each: parts of _CUT characters."""
    ahead = _prefixed(F.col("all_spans"), "struct<start: int, kind: int, end: int>", lambda x: x["end"], F.greatest, 0)
    begun = lambda p: F.filter(p, lambda r: r["x"]["start"] >= r["before"])
    # A run ends where the spans ahead of the next one do, the last run with the last of all ends.
    last = F.array_max(F.transform("all_spans", lambda s: s["end"]))
    runs = _let(ahead, lambda p: _let(begun(p), lambda b: F.transform(b, lambda r, i: F.struct(r["x"]["start"].alias("start"), F.coalesce(F.get(b, i + 1)["before"], last).alias("end")))))
    one = f"""
        transform(regexp_extract_all(text, '(?s).{{1,{_CUT}}}', 0), (part, k) -> aggregate(
          filter(runs, r -> r.start < (k + 1) * {_CUT} AND r.end > k * {_CUT}),
          named_struct('at', 0, 'out', ''),
          (a, r) -> named_struct('at', least(r.end - k * {_CUT}, {_CUT}), 'out',
            CASE WHEN r.start < k * {_CUT} THEN a.out ELSE concat(a.out, substr(part, a.at + 1, r.start - k * {_CUT} - a.at), '{MASK}') END),
          a -> concat(a.out, substr(part, a.at + 1))))"""
    return runs, one


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret of the text replaced by MASK, and n_chars, where docs has it, counted anew for the texts that change.

    Spans that overlap are masked as one. Columns and rows stay as they are otherwise: null and empty texts too, and repeated rows
    are changed alike. An empty table gives an empty result.
    """
    # The spans travel beside the row's own columns under names that these can't clash with.
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = find_secrets(docs.select(own, F.col("text")))
    hit = F.size("all_spans") > 0
    runs, masked = _masked()
    found = found.withColumn("runs", F.when(hit, runs))
    found = found.withColumn("_masked", F.when(hit, F.array_join(F.expr(masked), "")).otherwise(F.col("text")))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_masked").alias(c))
        elif c == "n_chars":
            columns.append(F.when(hit, F.char_length("_masked").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return found.select(*columns)
