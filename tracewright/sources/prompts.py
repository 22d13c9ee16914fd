"""Prompt files of a judge: a header of YAML between lines of ---, with name and version, and the text after it."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_FORM = re.compile(r"---[ \t]*\n(.*?)\n---[ \t]*\n(.*)", re.DOTALL)


class PromptError(ValueError):
    """A file that is no prompt."""


@dataclass(frozen=True)
class Prompt:
    """sha256 is that of the whole file, header included, so that any change shows."""

    name: str
    version: int
    text: str
    sha256: str


def parse_prompt(raw: str, where: str = "prompt") -> Prompt:
    import yaml

    found = _FORM.fullmatch(raw)
    if not found:
        raise PromptError(f"{where}: no header between --- and ---")
    try:
        header = yaml.safe_load(found[1])
    except yaml.YAMLError as e:
        raise PromptError(f"{where}: no YAML: {e}") from e
    name, version = (header.get(k) for k in ("name", "version")) if isinstance(header, dict) else (None, None)
    if not isinstance(name, str) or not name:
        raise PromptError(f"{where}: name is missing")
    if not isinstance(version, int) or isinstance(version, bool):
        raise PromptError(f"{where}: version is no integer")
    return Prompt(name, version, found[2], hashlib.sha256(raw.encode()).hexdigest())


def load_prompts(spark: SparkSession, path: str) -> list[Prompt]:
    """The prompts of a file, or of the files of a folder, by name; any store that Spark reads will do. Prompts are few and small."""
    rows = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").collect()
    out = sorted((parse_prompt(r.value, r.file_path) for r in rows), key=lambda p: p.name)
    if twice := {a.name for a, b in zip(out, out[1:], strict=False) if a.name == b.name}:
        raise PromptError(f"several prompts are named {', '.join(sorted(twice))}")
    return out


def prompt_table(spark: SparkSession, prompts: list[Prompt]) -> DataFrame:
    return spark.createDataFrame([(p.name, p.version, p.text, p.sha256) for p in prompts], "prompt_name string, version int, prompt string, sha256 string")
