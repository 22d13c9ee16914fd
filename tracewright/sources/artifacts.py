"""Artifacts of training as JSON files: the logistic classifier and the calibrators. Loading is strict, and nothing is ever unpickled."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracewright.functions.scores import LogisticModel
from tracewright.sources.folders import Folder

FORMAT = "tracewright-lr/v1"
TOLERANCE = 1e-6
_KEYS = {"format", "features", "means", "scales", "coef", "intercept", "C", "cv", "training_domains", "base_rate", "n_train"}
_CALIBRATOR_KEYS = {"a", "b", "clip", "n", "n_pos", "method"}


class ArtifactError(ValueError):
    """A file that isn't the artifact it should be."""


def _need(ok: object, message: str) -> None:
    if not ok:
        raise ArtifactError(message)


def _numbers(found: object, n: int | None = None) -> bool:
    return isinstance(found, list) and (n is None or len(found) == n) and all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in found)


def model_object(model: LogisticModel, c: float, cv: Mapping[float, float], n: int) -> dict:
    """The artifact of a model, the C that was chosen, the mean log-loss of each C, and the number of rows."""
    return {
        "format": FORMAT, "features": list(model.features), "means": list(model.means), "scales": list(model.scales), "coef": list(model.coefficients), "intercept": model.intercept, "C": c,
        "cv": {"grid": list(cv), "logloss": list(cv.values())}, "training_domains": list(model.domains), "base_rate": model.base_rate, "n_train": n,
    }


def checked_model(found: object) -> LogisticModel:
    """The model of an artifact; anything but exactly its keys, of their kinds and lengths, is an error."""
    _need(isinstance(found, dict) and found.get("format") == FORMAT, f"format is {FORMAT}")
    _need(set(found) == _KEYS, f"keys that differ: {', '.join(sorted(set(found) ^ _KEYS))}")
    names = found["features"]
    _need(isinstance(names, list) and names and all(isinstance(x, str) for x in names) and len(set(names)) == len(names), "features are names, each once")
    for key in ("means", "scales", "coef"):
        _need(_numbers(found[key], len(names)), f"{key} has a finite number for each feature")
    _need(all(s > 0 for s in found["scales"]), "scales are above 0")
    _need(_numbers([found["intercept"], found["base_rate"], found["C"]]) and 0 <= found["base_rate"] <= 1 and found["C"] > 0, "intercept, base_rate and C are numbers in their ranges")
    _need(isinstance(found["training_domains"], list) and all(isinstance(x, str) for x in found["training_domains"]), "training_domains are names")
    return LogisticModel(names, found["means"], found["scales"], found["coef"], found["intercept"], found["training_domains"], found["base_rate"])


def differences(a: LogisticModel, b: LogisticModel, tolerance: float = TOLERANCE) -> list[str]:
    """In what two models differ by more than the tolerance: names of their parts."""
    if list(a.features) != list(b.features):
        return ["features"]
    far = lambda x, y: any(abs(p - q) > tolerance for p, q in zip(x, y, strict=True))
    parts = {"means": (a.means, b.means), "scales": (a.scales, b.scales), "coef": (a.coefficients, b.coefficients), "intercept": ([a.intercept], [b.intercept])}
    return [k for k, (x, y) in parts.items() if far(x, y)] + (["training_domains"] if set(a.domains) != set(b.domains) else [])


@dataclass(frozen=True)
class CalibratorSet:
    """Platt calibrators by detector: a, b, clip, n, n_pos and method."""

    fitted_on: str
    base_rate: float
    calibrators: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    @classmethod
    def fitted(cls, table: DataFrame, fitted_on: str, base_rate: float) -> CalibratorSet:
        """Of fitted calibrators (detector, a, b, n, n_pos), a row for each detector."""
        rows = table.select("detector", "a", "b", "n", "n_pos").collect()
        return cls(fitted_on, base_rate, {r.detector: {"a": r.a, "b": r.b, "clip": 1e-6, "n": r.n, "n_pos": r.n_pos, "method": "platt"} for r in sorted(rows)})

    def table(self, spark: SparkSession) -> DataFrame:
        """detector, a and b."""
        return spark.createDataFrame([(k, float(c["a"]), float(c["b"])) for k, c in self.calibrators.items()], "detector string, a double, b double")

    def to_object(self) -> dict:
        return {"version": 1, "fitted_on": self.fitted_on, "base_rate": self.base_rate, "calibrators": {k: dict(c) for k, c in self.calibrators.items()}}


def checked_calibrators(found: object) -> CalibratorSet:
    _need(isinstance(found, dict) and found.get("version") == 1 and set(found) == {"version", "fitted_on", "base_rate", "calibrators"}, "version 1 of a calibrator set")
    _need(isinstance(found["fitted_on"], str) and _numbers([found["base_rate"]]) and isinstance(found["calibrators"], dict), "fitted_on, base_rate and calibrators")
    for name, c in found["calibrators"].items():
        _need(isinstance(c, dict) and set(c) == _CALIBRATOR_KEYS and c["method"] == "platt" and _numbers([c["a"], c["b"], c["clip"], c["n"], c["n_pos"]]), f"{name} is no calibrator")
    return CalibratorSet(found["fitted_on"], found["base_rate"], found["calibrators"])


class ArtifactFolder:
    """lr.json and calibration.json in a folder, each written whole and never over another."""

    MODEL, CALIBRATION = "lr.json", "calibration.json"

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def save(self, name: str, found: dict) -> None:
        if not self.folder.put_text(name, json.dumps(found, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"):
            raise FileExistsError(f"there is a {name} already")

    def _object(self, name: str) -> object:
        raw = self.folder.get_text(name)
        _need(raw is not None, f"{name} is missing")
        try:
            return json.loads(raw)
        except ValueError as e:
            raise ArtifactError(f"{name} is no JSON: {e}") from e

    def model(self) -> LogisticModel:
        return checked_model(self._object(self.MODEL))

    def chosen_c(self) -> float:
        found = self._object(self.MODEL)
        checked_model(found)
        return float(found["C"])

    def calibrators(self) -> CalibratorSet:
        return checked_calibrators(self._object(self.CALIBRATION))
