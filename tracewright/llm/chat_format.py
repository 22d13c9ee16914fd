"""Tool-call linking in conversations, with Spark's own functions only.

Calls and results are joined by identifier, calls are put in topological order of what they wait for, their arguments are
validated against schemas that are compiled to column expressions, and each call becomes one line of canonical JSON. There
is one row for each identifier, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.storage import written

_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def _violations(schema: Mapping, arguments: Column) -> Column:
    """Names of what is wrong with a VARIANT object: a subset of JSON Schema (required, properties' type, enum, minLength and minimum, additionalProperties)."""
    wrong = [F.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("object"))]
    for name in schema.get("required", ()):
        wrong.append(F.when(F.try_variant_get(arguments, _path(name), "variant").isNull(), F.lit(f"{name}:required")))
    for name, rule in schema.get("properties", {}).items():
        value = F.try_variant_get(arguments, _path(name), "variant")
        if "type" in rule:
            wrong.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(f"^{_TYPES[rule['type']]}$"), F.lit(f"{name}:type")))
        if "enum" in rule:
            wrong.append(F.when(value.isNotNull() & ~F.to_json(value).isin([json.dumps(v, ensure_ascii=False) for v in rule["enum"]]), F.lit(f"{name}:enum")))
        if "minLength" in rule:
            wrong.append(F.when(F.char_length(F.try_variant_get(arguments, _path(name), "string")) < rule["minLength"], F.lit(f"{name}:minLength")))
        if "minimum" in rule:
            wrong.append(F.when(F.try_variant_get(arguments, _path(name), "double") < rule["minimum"], F.lit(f"{name}:minimum")))
    if schema.get("additionalProperties") is False:
        known = F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>")
        keys = F.json_object_keys(F.to_json(arguments))
        wrong.append(F.when(F.size(F.array_except(keys, known)) > 0, F.lit("additionalProperties")))
    return F.filter(F.array(*wrong), lambda x: x.isNotNull())


def _path(name: str) -> str:
    return f"$['{name}']"


def _peeled(nodes: DataFrame, waits: DataFrame) -> DataFrame:
    """conv_id, call_id, level of nodes (conv_id, call_id), a round for each level; those on a cycle, or behind one, are left out."""
    nodes, waits, level, turn = written(nodes, "nodes"), written(waits, "waits"), None, 0
    while True:
        free = written(nodes.join(waits, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(turn).cast("long")), "free")
        level = free if level is None else level.unionByName(free)
        if free.isEmpty():
            return level
        nodes = written(nodes.join(free, ["conv_id", "call_id"], "left_anti"), "nodes")
        waits = written(waits.join(free.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_anti").select("conv_id", "call_id", "parent"), "waits")
        turn += 1


def _doubled(nodes: DataFrame, waits: DataFrame) -> DataFrame:
    """The same where each node waits for one call at most: every round doubles the stretch of the chain that a node has seen.

    A conversation of n calls takes log2(n) rounds; who still waits after them is on a cycle, or behind one.
    """
    state = nodes.join(waits.withColumnRenamed("parent", "up"), ["conv_id", "call_id"], "left").withColumn("level", F.col("up").isNotNull().cast("long"))
    state = written(state.select("conv_id", "call_id", "up", "level"), "chains")
    longest = state.groupBy("conv_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    for _ in range(longest.bit_length()):
        waiting = state.where("up IS NOT NULL")
        if waiting.isEmpty():
            break
        # Nodes without a wait stay out of the join: their null would bring a conversation's rows into one task.
        ups = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = waiting.join(ups, ["conv_id", "up"]).select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        state = written(state.where("up IS NULL").unionByName(moved), "chains")
    return state.where("up IS NULL").select("conv_id", "call_id", "level")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, missing (ids waited for that aren't there) and level of calls (conv_id, call_id, turn, after).

    The level is the length of the longest chain of calls that the call waits for, whatever their turns; on a cycle, or behind one,
    it is null. Conversations whose calls wait for one call each at most are solved by doubling, the others peeled level by level.
    """
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("parent")).where("parent IS NOT NULL").distinct()
    there = calls.select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("there"))
    edges = edges.join(there, ["conv_id", "parent"], "left")
    missing = edges.where("there IS NULL").groupBy("conv_id", "call_id").agg(F.count("*").alias("missing"))
    waits = written(edges.where("there").select("conv_id", "call_id", "parent"), "waits")
    branched = written(waits.groupBy("conv_id", "call_id").agg(F.count("*").alias("c")).where("c > 1").select("conv_id").distinct(), "branched")
    nodes = calls.select("conv_id", "call_id")
    if branched.isEmpty():
        level = _doubled(nodes, waits)
    else:
        parts = [(nodes.join(branched, "conv_id", how), waits.join(branched, "conv_id", how)) for how in ("left_anti", "left_semi")]
        level = _doubled(*parts[0]).unionByName(_peeled(*parts[1]))
    out = nodes.join(missing, ["conv_id", "call_id"], "left").join(level, ["conv_id", "call_id"], "left")
    return out.select("conv_id", "call_id", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"), "level")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row for each (conv_id, call_id) of calls or results.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (array of call ids, or null). results: conv_id, call_id,
    turn, content. Other columns are ignored. Returns conv_id, call_id, turn (the call's, else the result's), level (see levels),
    missing, linked (both are there), valid (a known name, arguments that fit its schema, no cycle), problems and record (canonical
    JSON: keys ascend, no blanks). Of calls, or results, with one identifier the first stays, by turn and then by content. Rows
    without conv_id or call_id link with nothing and are left out. A result without a call has a record without arguments, not valid.
    Empty tables give an empty result.
    """
    key = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    first = lambda df, cols: df.where(key).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *cols)).alias("x")).select("conv_id", "call_id", "x.*")
    calls = first(calls, ["name", "arguments", "after"])
    results = first(results, ["content"]).withColumnRenamed("turn", "result_turn").withColumn("answered", F.lit(True))
    ordered = levels(calls)
    joined = calls.withColumn("called", F.lit(True)).join(ordered, ["conv_id", "call_id"]).join(results, ["conv_id", "call_id"], "full_outer")
    joined = joined.withColumn("parsed", F.try_parse_json("arguments"))
    problems = F.array(F.lit("call")).cast("array<string>")
    for name, schema in schemas.items():
        problems = F.when(F.col("name") == name, _violations(schema, F.col("parsed"))).otherwise(problems)
    problems = F.when(F.col("called").isNull(), F.array(F.lit("call"))).when(F.col("name").isin(list(schemas)), problems).otherwise(F.array(F.lit("name")))
    problems = F.when(F.col("called") & F.col("level").isNull(), F.concat(problems, F.array(F.lit("cycle")))).otherwise(problems)
    out = joined.withColumn("problems", problems)
    called, answered = F.coalesce("called", F.lit(False)), F.coalesce("answered", F.lit(False))
    record = F.to_json(
        F.struct(F.col("parsed").alias("arguments"), F.col("content"), F.col("call_id").alias("id"), F.col("name"), F.col("turn")),
        {"ignoreNullFields": "true"},
    )
    return out.select(
        "conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "level", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
        (called & answered).alias("linked"), (F.size("problems") == 0).alias("valid"), F.concat_ws(",", "problems").alias("problems"), record.alias("record"),
    )


#: The turns of a plain conversation as tools: what is asked, and what is set up.
TURN_SCHEMAS = {
    "reply": {"required": ["prompt", "turn"], "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False},
    "configure": {"required": ["text"], "properties": {"text": {"type": "string"}}, "additionalProperties": False},
}


def link_turns(conversations: DataFrame) -> DataFrame:
    """link_tool_calls over plain conversations (conv_id, turn, role, text; other columns are ignored).

    A user's turn is a call of `reply`, an assistant's the result of the turn before it; any other turn is a call of `configure`.
    The identifier is the call's turn. From turn 2 on a call waits for the one two turns before. A null text is an argument,
    or a content, that is missing.
    """
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    asks = F.coalesce(F.col("role") == "user", F.lit(False))
    arguments = F.when(asks, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).otherwise(F.to_json(F.struct("text")))
    calls = c.where("role IS NULL OR role != 'assistant'").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.when(asks, "reply").otherwise("configure").alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array((F.col("turn") - 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return link_tool_calls(calls, results, TURN_SCHEMAS)
