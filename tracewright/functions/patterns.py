"""Translation of globs and of Python regular expressions to the dialect of the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """A case-sensitive glob (``*``, ``?``, ``[..]``, ``[!..]``) as a regular expression for the whole string."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + (glob[i : i + 1] in ("!", "]")) + (glob[i : i + 2] == "!]"))) > 0:
            inner = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return r"^(?s:" + "".join(out) + r")\z"


def matches_glob(name: Column, globs: list[str]) -> Column:
    """Whether a name matches one of the globs; a null or empty name doesn't."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | name.rlike(glob_to_regex(g))
    return F.coalesce((name != "") & hit, F.lit(False))


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern for the JVM: named groups, and classes and boundaries by Unicode."""
    re.compile(pattern)
    return ("(?iuU)" if ignore_case else "(?U)") + re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + m[1].replace("_", "") + ">", pattern)
