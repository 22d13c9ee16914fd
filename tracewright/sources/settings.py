"""Settings of a check from the command line, the environment, a TOML file and defaults, in this order."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from tracewright.functions.scores import Thresholds


class SettingsError(ValueError):
    """A setting that isn't known, or has a value of another kind."""


@dataclass(frozen=True)
class Setting:
    kind: type
    default: object = None
    env: str | None = None


#: Settings by their dotted name; the part before the dot is the table of the TOML file.
SETTINGS = {
    "gate.verified": Setting(float, 0.80),
    "gate.false_success": Setting(float, 0.20),
    "judge.base_url": Setting(str, None, "TRACEWRIGHT_BASE_URL"),
    "judge.model": Setting(str, None, "TRACEWRIGHT_MODEL"),
    "judge.prompt": Setting(str),
    "judge.temperature": Setting(float, 0.0),
    "judge.max_tokens": Setting(int, 400),
    "judge.timeout_s": Setting(float, 60.0),
    "judge.in_flight": Setting(int, 8),
    "judge.price_in": Setting(float),
    "judge.price_out": Setting(float),
    "budget.max_usd": Setting(float, 1.0, "TRACEWRIGHT_MAX_USD"),
    "budget.ledger": Setting(str, None, "TRACEWRIGHT_LEDGER"),
    "budget.ledger_cap_usd": Setting(float, None, "TRACEWRIGHT_LEDGER_CAP_USD"),
    "rules.packs": Setting(list, ()),
    "classifier.model": Setting(str),
    "classifier.calibration": Setting(str),
}


def _cast(name: str, value: object, kind: type, text: bool) -> object:
    """The value in its kind: numbers may be text in the environment, an integer may stand for a float, and no boolean for a number."""
    try:
        if text and kind in (float, int):
            return kind(value)
        if text and kind is list:
            return tuple(x for x in str(value).split(",") if x)
    except ValueError as e:
        raise SettingsError(f"{name}: {value!r} is no {kind.__name__}") from e
    if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else (list, tuple) if kind is list else kind):
        raise SettingsError(f"{name}: {value!r} is no {kind.__name__}")
    return float(value) if kind is float else tuple(value) if kind is list else value


def load_settings(file: str | None = None, given: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None) -> dict[str, object]:
    """All SETTINGS by name. A file that is named has to be there; unknown names in it or in `given` are errors; a `given` None is not given."""
    found = {}
    if file is not None:
        try:
            tables = tomllib.loads(Path(file).read_text(encoding="utf-8"))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise SettingsError(f"{file}: {e}") from e
        found = {f"{t}.{k}": v for t, body in tables.items() for k, v in (body.items() if isinstance(body, dict) else {"": body}.items())}
    given, environment = {k: v for k, v in (given or {}).items() if v is not None}, os.environ if environment is None else environment
    if unknown := (set(found) | set(given)) - set(SETTINGS):
        raise SettingsError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for name, s in SETTINGS.items():
        if name in given:
            out[name] = _cast(name, given[name], s.kind, False)
        elif s.env and environment.get(s.env):
            out[name] = _cast(s.env, environment[s.env], s.kind, True)
        else:
            out[name] = _cast(name, found[name], s.kind, False) if name in found else s.default
    return out


def thresholds(settings: Mapping[str, object]) -> Thresholds:
    return Thresholds(settings["gate.verified"], settings["gate.false_success"])
