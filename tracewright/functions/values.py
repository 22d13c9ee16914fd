"""Column expressions on schemaless values (VARIANT): dotted paths, normalised forms and equality."""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d[\d_]*(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def _quoted(key: str) -> str:
    return '["' + key + '"]' if "'" in key else "['" + key + "']"


def get_path(value: Column, path: str) -> Column:
    """The value at a dotted path, or SQL null where it isn't found; a JSON null is found.

    Digits are an index of a list or a key of an object, as the data have it; a negative index counts from the end.
    """
    if path == "":
        return value
    parts = path.split(".")
    if any(p.startswith("-") and p[1:].isdigit() for p in parts):
        for p in parts:
            if p.lstrip("-").isdigit():
                items = F.try_variant_get(value, "$", "array<variant>")
                at = int(p) if p.startswith("-") else int(p) + 1
                value = F.coalesce(F.try_element_at(items, F.lit(at)), F.try_variant_get(value, "$" + _quoted(p), "variant"))
            else:
                value = F.try_variant_get(value, "$" + _quoted(p), "variant")
        return value
    ways = [(f"[{int(p)}]", _quoted(p)) if p.isdigit() else (_quoted(p),) for p in parts]
    found = [F.try_variant_get(value, "$" + "".join(w), "variant") for w in product(*ways)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return kind(value) == "STRING"


def text(value: Column) -> Column:
    """Strings as they are; other values as their JSON text, keys in order."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def python_text(value: Column) -> Column:
    """text, but true, false and null as Python writes them."""
    raw = F.to_json(value)
    named = F.when(raw == "true", "True").when(raw == "false", "False").when(raw == "null", "None").otherwise(raw)
    return F.when(is_text(value), F.try_variant_get(value, "$", "string")).otherwise(named)


def number(value: Column) -> Column:
    """The number that a value is or spells; booleans have none."""
    raw = text(value)
    return F.when((kind(value) != "BOOLEAN") & raw.rlike(NUMBER), F.regexp_replace(F.trim(raw), "_", "").try_cast("double"))


def moment(value: Column) -> Column:
    """The instant of an ISO date or date-time; without an offset it is in UTC, as is the session."""
    raw = F.try_variant_get(value, "$", "string")
    return F.when(is_text(value) & raw.rlike(MOMENT), F.try_to_timestamp(F.regexp_replace(raw, ",", ".")))


def normalised(value: Column, form: str) -> Column:
    """The value in the form datetime, email, number or string; null where it has none."""
    if form == "datetime":
        return moment(value)
    if form == "number":
        return number(value)
    if form == "email":
        return F.when(is_text(value), F.lower(F.trim(F.try_variant_get(value, "$", "string"))))
    if form == "string":
        return F.lower(F.trim(python_text(value)))
    raise ValueError(f"unknown form: {form}")


def equal(a: Column, b: Column, form: str | None) -> Column:
    """Whether two found values are equal, in a form if one is given. Never null."""
    if form == "number":
        same = F.abs(number(a) - number(b)) <= 1e-9
    elif form:
        same = normalised(a, form) == normalised(b, form)
    else:
        as_number = lambda v: F.when(F.to_json(v) == "true", "1").when(F.to_json(v) == "false", "0").otherwise(F.to_json(v))
        same = as_number(a) == as_number(b)
    return F.coalesce(same, F.lit(False))


def constant(value: object) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def as_variant(raw: Column) -> Column:
    return F.try_parse_json(F.to_json(F.struct(raw.alias("v"))))
