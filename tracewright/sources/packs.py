"""Rule packs: YAML files that say which tool receipts and state probes support a claim. They are compiled, never run."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

OPERATIONS = ("exists", "equals", "in", "contains", "matches")
FORMS = ("datetime", "email", "number", "string")
_KEYS = {"pack", "version", "tools", "claim_patterns", "claims"}
_CLAIM_KEYS = {"action", "receipt", "probe", "probe_checks"}


@dataclass(frozen=True)
class Check:
    path: str
    op: str
    value: Any
    form: str | None = None


@dataclass(frozen=True)
class Rule:
    action: str
    receipt: tuple[Check, ...] = ()
    probe: str | None = None
    probe_checks: tuple[Check, ...] = ()


@dataclass(frozen=True)
class RulePack:
    name: str
    version: int
    tools: tuple[str, ...] = ()
    patterns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    claims: Mapping[str, Rule] = field(default_factory=dict)


class PackError(ValueError):
    """A rule pack that breaks the rules of its form."""


def _need(ok: object, message: str) -> None:
    if not ok:
        raise PackError(message)


def _checks(found: Mapping[str, Mapping[str, Any]] | None, where: str) -> tuple[Check, ...]:
    out = []
    for path, body in (found or {}).items():
        _need(isinstance(body, Mapping), f"{where}.{path}: a check is a mapping")
        ops = [k for k in body if k in OPERATIONS]
        _need(len(ops) == 1 and set(body) <= {ops[0], "as"}, f"{where}.{path}: exactly one of {', '.join(OPERATIONS)}, and as")
        op, form = ops[0], body.get("as")
        _need(form is None or form in FORMS, f"{where}.{path}: as is one of {', '.join(FORMS)}")
        _need(op != "exists" or isinstance(body[op], bool), f"{where}.{path}: exists is true or false")
        _need(op != "in" or isinstance(body[op], list), f"{where}.{path}: in is a list")
        if op == "matches":
            try:
                re.compile(body[op])
            except (re.error, TypeError) as e:
                raise PackError(f"{where}.{path}: {e}") from e
        out.append(Check(str(path), op, body[op], form))
    return tuple(out)


def parse_pack(text: str) -> RulePack:
    import yaml

    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise PackError(f"no YAML: {e}") from e
    _need(isinstance(found, Mapping) and isinstance(found.get("pack"), str), "a pack has a name under pack")
    _need(set(found) <= _KEYS, f"unknown keys: {', '.join(sorted(map(str, set(found) - _KEYS)))}")
    _need(isinstance(found.get("version"), int) and not isinstance(found.get("version"), bool), "version is an integer")
    patterns = {}
    for claim, several in (found.get("claim_patterns") or {}).items():
        for p in several:
            try:
                re.compile(p, re.IGNORECASE)
            except re.error as e:
                raise PackError(f"claim_patterns.{claim}: {e}") from e
        patterns[claim] = tuple(several)
    claims = {}
    for claim, body in (found.get("claims") or {}).items():
        _need(isinstance(body, Mapping) and isinstance(body.get("action"), str) and set(body) <= _CLAIM_KEYS, f"claims.{claim}: action, receipt, probe, probe_checks")
        claims[claim] = Rule(body["action"], _checks(body.get("receipt"), f"claims.{claim}.receipt"), body.get("probe"), _checks(body.get("probe_checks"), f"claims.{claim}.probe_checks"))
    return RulePack(found["pack"], found["version"], tuple(found.get("tools") or ()), patterns, claims)


def load_pack(path: str | Path) -> RulePack:
    return parse_pack(Path(path).read_text(encoding="utf-8"))


def builtin_packs() -> list[RulePack]:
    """The packs that come with the library, in the order in which they are asked."""
    folder = Path(__file__).parent / "packs"
    return [load_pack(folder / f"{name}.yaml") for name in ("booking", "crm", "coding", "generic")]
