"""Traces as JSON lines: reading with line numbers, validation with JSON paths, and the three tables of the engine.

The envelope is fixed and strict; args, output, error, subject, details and meta hold any JSON and stay VARIANT. A JSON null
and a missing key are the same for name, content, args, ok and error, but not inside output, subject and args.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.values import kind
from tracewright.sources.folders import Folder, pinned

# The form of a trace line.
FORMAT = "agent-trace/v1"
DOMAINS = ("booking", "crm", "coding", "browser", "other")
KINDS = ("message", "tool_call", "tool_result", "state_probe")
ROLES = ("user", "agent", "tool", "environment")
LABELS = ("success", "failure", "unknown")
CHECKED_BY = ("state_probe", "human", "none")
# End of fixed values.

PROBE_KEYS = ("trace_id", "name", "ok", "ts", "args", "output", "error")
_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


class TraceLineError(ValueError):
    """The first invalid line of a file that is read strictly."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, lines counted from 1 in each file, blank ones too.

    Lines are numbered inside each split of a file; the splits' sizes, a row for each, give the numbers of those before.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    sizes = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(sizes, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def _at(v: Column, path: str, as_: str = "variant") -> Column:
    return F.try_variant_get(v, path, as_)


def _error(bad: Column, path: Column | str, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.struct((F.lit(path) if isinstance(path, str) else path).alias("json_path"), F.lit(message).alias("message")))


def _keys(v: Column, allowed: tuple[str, ...], required: tuple[str, ...], path: Column | str) -> list[Column]:
    """Errors of an object: its type, unknown keys and missing ones."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    names, is_object = F.coalesce(F.map_keys(fields), F.array().cast("array<string>")), fields.isNotNull()
    out = [_error(~is_object, path, "not an object"), _error(is_object & (F.size(F.array_except(names, F.array(*(F.lit(a) for a in allowed)))) > 0), path, "unknown key")]
    return out + [_error(is_object & ~F.array_contains(names, r), path, f"{r} is missing") for r in required]


def _is(v: Column, types: str, optional: bool = False) -> Column:
    """Whether a value has one of the types; what is optional may be missing or null."""
    # Containers by a cast that only they survive; the schema of a large value would be worked out in full.
    ways = {"OBJECT": "map<string,variant>", "ARRAY": "array<variant>"}
    ok = F.lit(False)
    for t in types.split("|"):
        ok = ok | (F.try_variant_get(v, "$", ways[t]).isNotNull() if t in ways else F.coalesce(kind(v) == t, F.lit(False)))
    return ok | (v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))) if optional else ok


def _choice(v: Column, values: tuple[str, ...], path: Column | str) -> Column:
    return _error(v.isNotNull() & ~F.coalesce(_at(v, "$", "string").isin(*values) & (kind(v) == "STRING"), F.lit(False)), path, "not one of " + ", ".join(values))


def _text(v: Column, path: Column | str, least: int = 0) -> Column:
    return _error(v.isNotNull() & ~F.coalesce(_is(v, "STRING") & (F.char_length(_at(v, "$", "string")) >= least), F.lit(False)), path, "not a text" if not least else "not a text, or empty")


def _step_errors(s: Column, at: Column) -> Column:
    path = F.concat(F.lit("$.steps["), at.cast("string"), F.lit("]"))
    sub = lambda k: F.concat(path, F.lit("." + k))
    get = lambda k: _at(s, f"$.{k}")
    errors = _keys(s, ("i", "ts", "kind", "role", "name", "content", "args", "ok", "output", "error"), ("i", "ts", "kind", "role"), path)
    errors += [
        _error(get("i").isNotNull() & ~(_is(get("i"), "BIGINT") & F.coalesce(_at(s, "$.i", "bigint") >= 0, F.lit(False))), sub("i"), "not an integer from 0 on"),
        _error(get("ts").isNotNull() & ~F.coalesce(_at(s, "$.ts", "string").rlike(_TIME), F.lit(False)), sub("ts"), "not a date-time"),
        _choice(get("kind"), KINDS, sub("kind")), _choice(get("role"), ROLES, sub("role")),
        _error(~_is(get("name"), "STRING", True), sub("name"), "not a text"), _error(~_is(get("content"), "STRING", True), sub("content"), "not a text"),
        _error(~_is(get("args"), "OBJECT", True), sub("args"), "not an object"), _error(~_is(get("ok"), "BOOLEAN", True), sub("ok"), "not true or false"),
        _error(~_is(get("error"), "STRING|OBJECT", True), sub("error"), "not a text or an object"),
    ]
    return F.array(*errors)


def line_errors(v: Column) -> Column:
    """array<struct<json_path, message>> of what is wrong with the form of a parsed line, by path and message."""
    get = lambda k: _at(v, f"$.{k}")
    errors = _keys(v, ("schema", "trace_id", "source", "task", "steps", "final_claim", "ground_truth", "meta"), ("schema", "trace_id", "source", "task", "steps", "final_claim"), "$")
    errors += [_choice(get("schema"), (FORMAT,), "$.schema"), _text(get("trace_id"), "$.trace_id", 1), _text(get("source"), "$.source", 1)]
    task = get("task")
    errors += [F.when(task.isNotNull(), e) for e in _keys(task, ("id", "domain", "instruction"), ("id", "domain", "instruction"), "$.task")]
    errors += [_text(get("task.id"), "$.task.id"), _choice(get("task.domain"), DOMAINS, "$.task.domain"), _text(get("task.instruction"), "$.task.instruction")]
    final = get("final_claim")
    errors += [F.when(final.isNotNull(), e) for e in _keys(final, ("text", "claims"), ("text",), "$.final_claim")]
    errors += [_error(~_is(get("final_claim.text"), "STRING", True), "$.final_claim.text", "not a text"), _error(get("final_claim.claims").isNotNull() & ~_is(get("final_claim.claims"), "ARRAY"), "$.final_claim.claims", "not a list")]
    truth = get("ground_truth")
    there = truth.isNotNull() & ~F.is_variant_null(truth)
    errors += [F.when(there, e) for e in _keys(truth, ("outcome", "checked_by", "details"), ("outcome", "checked_by"), "$.ground_truth")]
    errors += [F.when(there, _choice(get("ground_truth.outcome"), LABELS, "$.ground_truth.outcome")), F.when(there, _choice(get("ground_truth.checked_by"), CHECKED_BY, "$.ground_truth.checked_by"))]
    errors += [_error(get("steps").isNotNull() & ~_is(get("steps"), "ARRAY"), "$.steps", "not a list"), _error(~_is(get("meta"), "OBJECT", True), "$.meta", "not an object")]
    steps = F.coalesce(_at(v, "$.steps", "array<variant>"), F.array().cast("array<variant>"))
    claims = F.coalesce(_at(v, "$.final_claim.claims", "array<variant>"), F.array().cast("array<variant>"))

    def claim(c: Column, i: Column) -> Column:
        path = F.concat(F.lit("$.final_claim.claims["), i.cast("string"), F.lit("]"))
        return F.array(*_keys(c, ("type", "subject"), ("type",), path), _text(_at(c, "$.type"), F.concat(path, F.lit(".type"))), _error(~_is(_at(c, "$.subject"), "OBJECT", True), F.concat(path, F.lit(".subject")), "not an object"))

    each = F.concat(F.array(*errors), F.flatten(F.transform(steps, _step_errors)), F.flatten(F.transform(claims, claim)))
    return F.array_sort(F.filter(each, lambda e: e.isNotNull()))


@dataclass(frozen=True)
class Loaded:
    """The valid lines (line_no, trace_id, v VARIANT) and the errors (line_no, json_path, message), both with file where lines have it."""

    lines: DataFrame
    errors: DataFrame

    def traces(self) -> DataFrame:
        v = F.col("v")
        return self.lines.select(
            "trace_id", "line_no", _at(v, "$.source", "string").alias("source"), _at(v, "$.task.domain", "string").alias("domain"), _at(v, "$.task.id", "string").alias("task_id"),
            _at(v, "$.task.instruction", "string").alias("instruction"), _at(v, "$.final_claim.text", "string").alias("final_text"),
            _at(v, "$.ground_truth.outcome", "string").alias("gt_outcome"), _at(v, "$.ground_truth.checked_by", "string").alias("gt_checked_by"), _at(v, "$.ground_truth.details").alias("gt_details"), _at(v, "$.meta").alias("meta"),
        )

    def steps(self) -> DataFrame:
        s = F.col("s")
        given = lambda k: F.when(~F.is_variant_null(_at(s, f"$.{k}")), _at(s, f"$.{k}"))
        each = self.lines.select("trace_id", F.explode(_at(F.col("v"), "$.steps", "array<variant>")).alias("s"))
        text = lambda k: _at(s, f"$.{k}", "string")
        return each.select("trace_id", _at(s, "$.i", "int").alias("i"), text("ts").alias("ts"), text("kind").alias("kind"), text("role").alias("role"), text("name").alias("name"), text("content").alias("content"), given("args").alias("args"), _at(s, "$.ok", "boolean").alias("ok"), _at(s, "$.output").alias("output"), given("error").alias("error"))

    def claims(self) -> DataFrame:
        c = F.col("c")
        each = self.lines.select("trace_id", F.posexplode(_at(F.col("v"), "$.final_claim.claims", "array<variant>")).alias("claim_idx", "c"))
        return each.select("trace_id", "claim_idx", _at(c, "$.type", "string").alias("type"), F.coalesce(_at(c, "$.subject"), F.parse_json(F.lit("{}"))).alias("subject"))


def validate(lines: DataFrame) -> Loaded:
    """Check (line_no, value) lines, with or without file: JSON, form, then ids that repeat and step numbers that don't ascend.

    Blank lines are passed over. Only lines of a clean form register their id; the later of two equal ids, by file and line, is the error:
    steps and claims are joined by id, so it has to be unique in all files that are loaded together.
    """
    place = ["file", "line_no"] if "file" in lines.columns else ["line_no"]
    parsed = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    form = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("$").alias("json_path"), F.lit("invalid JSON").alias("message")))).otherwise(line_errors(F.col("v")))
    # Lines are checked once: what follows, and whoever reads steps, claims or errors later, reads this table.
    formed = pinned(parsed.withColumn("errors", form).drop("value"), "lines").withColumn("trace_id", F.when(F.size("errors") == 0, _at(F.col("v"), "$.trace_id", "string")))
    first = F.when(F.col("trace_id").isNotNull(), F.min(F.struct(*place)).over(Window.partitionBy("trace_id")))
    places = F.transform(_at(F.col("v"), "$.steps", "array<variant>"), lambda s: _at(s, "$.i", "bigint"))
    steady = F.forall(F.sequence(F.lit(1), F.size("places") - 1), lambda k: F.get("places", k) > F.get("places", k - 1))
    other = [F.when(F.col("first.file") != F.col("file"), F.concat(F.lit(" of "), F.col("first.file"))).otherwise("")] if len(place) == 2 else []
    # Rows without an id don't meet in one window.
    with_id = formed.where("trace_id IS NOT NULL").withColumn("first", first).withColumn("places", places)
    late = F.filter(
        F.array(
            F.when(F.col("first") < F.struct(*place), F.struct(F.lit("$.trace_id").alias("json_path"), F.concat(F.lit("trace_id is that of line "), F.col("first.line_no").cast("string"), *other).alias("message"))),
            F.when((F.size("places") > 1) & ~steady, F.struct(F.lit("$.steps").alias("json_path"), F.lit("i doesn't ascend").alias("message"))),
        ),
        lambda e: e.isNotNull(),
    )
    checked = with_id.withColumn("errors", late).select(*place, "trace_id", "v", "errors")
    errors = formed.where("trace_id IS NULL").select(*place, F.explode("errors").alias("e")).unionByName(checked.select(*place, F.explode("errors").alias("e")))
    return Loaded(checked.where(F.size("errors") == 0).select(*place, "trace_id", "v"), errors.select(*place, "e.json_path", "e.message"))


def load_traces(spark: SparkSession, path: str, strict: bool = False) -> Loaded:
    """Read and check a file of traces; strict: the first invalid line is raised."""
    loaded = validate(read_lines(spark, path))
    if strict:
        first = loaded.errors.orderBy("file", "line_no", "json_path", "message").first()
        if first:
            raise TraceLineError(f"{first.file}, line {first.line_no}: {first.json_path}: {first.message}")
    return loaded


def load_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe lines (file, line_no, trace_id, name, ok, ts, args, output, error); an invalid one always fails the job."""
    v = F.try_parse_json("value")
    required = F.lit(True)
    for k in ("trace_id", "name", "ok", "ts"):
        required = required & F.coalesce(F.array_contains(F.json_object_keys(F.to_json("v")), k), F.lit(False))
    extra = F.size(F.array_except(F.json_object_keys(F.to_json("v")), F.array(*(F.lit(k) for k in PROBE_KEYS)))) > 0
    lines = read_lines(spark, path).where(F.trim("value") != "").withColumn("v", v)
    guarded = lines.withColumn("v", F.when(required & ~F.coalesce(extra, F.lit(True)), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("invalid probe in line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file"))).cast("variant")))
    given = lambda k: F.when(~F.is_variant_null(_at(F.col("v"), f"$.{k}")), _at(F.col("v"), f"$.{k}"))
    text = lambda k: _at(F.col("v"), f"$.{k}", "string").alias(k)
    return guarded.select("file", "line_no", text("trace_id"), text("name"), _at(F.col("v"), "$.ok", "boolean").alias("ok"), text("ts"), given("args").alias("args"), _at(F.col("v"), "$.output").alias("output"), given("error").alias("error"))


def detector_view(traces: DataFrame) -> DataFrame:
    """What a detector may see of a trace: no label, no meta, no source."""
    return traces.select("trace_id", "domain", "task_id", "instruction", "final_text")


def dump(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines with keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def trace_lines(lines: DataFrame, instead: Mapping[str, Column] | None = None) -> DataFrame:
    """trace_id and value, the line of each trace of (trace_id, v): its JSON text with keys in order, without ground_truth and meta that are null.

    instead: JSON text for some keys, whatever v has there.
    """
    instead = instead or {}
    v, fields = F.col("v"), F.try_variant_get("v", "$", "map<string,variant>")
    null = lambda k: F.coalesce(F.is_variant_null(_at(v, f"$.{k}")), F.lit(False))
    gone = lambda k: (F.lit(False) if not instead else k.isin(*instead)) | ((k == "ground_truth") & null("ground_truth")) | ((k == "meta") & null("meta"))
    own = F.transform(F.filter(F.map_keys(fields), lambda k: ~gone(k)), lambda k: F.struct(k.alias("k"), F.to_json(fields[k]).alias("j")))
    cells = F.array_sort(F.concat(own, *(F.array(F.struct(F.lit(k).alias("k"), j.alias("j"))) for k, j in instead.items())))
    quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r'^\{"k":(.*)\}$', 1)
    return lines.select("trace_id", F.concat(F.lit("{"), F.array_join(F.transform(cells, lambda c: F.concat(quoted(c["k"]), F.lit(":"), c["j"])), ","), F.lit("}")).alias("value"))


def write_sorted(lines: DataFrame, path: str) -> None:
    """Write (trace_id, value) as lines in the order of trace_id over the files in theirs, if all of them are valid traces.

    Lines are range-partitioned, so each task sorts and writes its own range. What was written is read and checked before the folder gets its name:
    an invalid line raises TraceLineError, and nothing is left behind.
    """
    spark = lines.sparkSession
    parent, _, name = path.rstrip("/").rpartition("/")
    folder, aside = Folder(spark, parent), f"_aside-{uuid.uuid4().hex}"
    if folder.exists(name):
        raise FileExistsError(f"{path} is there already")
    try:
        lines.repartitionByRange("trace_id").sortWithinPartitions("trace_id").select("value").write.text(folder.at(aside))
        first = validate(read_lines(spark, folder.at(aside))).errors.orderBy("file", "line_no", "json_path", "message").first()
        if first:
            raise TraceLineError(f"line {first.line_no} of {first.file.rpartition('/')[2]}: {first.json_path}: {first.message}")
        if not folder.rename_new(aside, name):
            raise FileExistsError(f"{path} is there already")
    finally:
        folder.delete(aside)
