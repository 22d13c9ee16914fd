"""Column expressions on scores: gate, confidence, Platt scaling, logistic models, and costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VERIFIED, FALSE_SUCCESS = 0.80, 0.20
CLIP = 1e-6


@dataclass(frozen=True)
class Thresholds:
    verified: float = VERIFIED
    false_success: float = FALSE_SUCCESS

    def __post_init__(self) -> None:
        if not 0 <= self.false_success < self.verified <= 1:
            raise ValueError("thresholds have to satisfy 0 <= false_success < verified <= 1")


def gate(p: Column, abstain: Column, t: Thresholds = Thresholds()) -> Column:
    """The verdict of a probability."""
    return F.when(abstain | p.isNull(), "unverifiable").when(p >= t.verified, "verified").when(p <= t.false_success, "false_success").otherwise("unverifiable")


def confidence(verdict: Column, p: Column) -> Column:
    return F.when(verdict == "verified", p).when(verdict == "false_success", 1 - p)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit(p: Column, clip: float = CLIP) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def platt(p: Column, a: Column | float, b: Column | float) -> Column:
    return sigmoid(logit(p) * a + b)


@dataclass(frozen=True)
class LogisticModel:
    """Coefficients over standardised features, and the domains that the model was trained on."""

    features: Sequence[str]
    means: Sequence[float]
    scales: Sequence[float]
    coefficients: Sequence[float]
    intercept: float
    domains: Sequence[str]
    base_rate: float

    @classmethod
    def from_json(cls, found: Mapping) -> LogisticModel:
        return cls(found["features"], found["means"], found["scales"], found["coef"], found["intercept"], found["training_domains"], found["base_rate"])

    def contributions(self) -> list[Column]:
        return [((F.col(f) - m) / s) * c for f, m, s, c in zip(self.features, self.means, self.scales, self.coefficients, strict=True)]

    def p_success(self) -> Column:
        total = F.lit(float(self.intercept))
        for c in self.contributions():
            total = total + c
        return sigmoid(total)

    def top_contributions(self, k: int = 10) -> Column:
        """The k features of the largest contribution by size, ties in the model's order."""
        parts = F.array(*(F.struct(F.abs(c).alias("size"), F.lit(-i).alias("place"), F.lit(f).alias("feature"), c.alias("value")) for i, (f, c) in enumerate(zip(self.features, self.contributions(), strict=True))))
        return F.transform(F.slice(F.sort_array(parts, asc=False), 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))


def reservation_usd(chars: Column, max_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """The most that a call may cost: characters over 2.5 as input tokens, the full output, a tenth on top."""
    return (chars / 2.5 * price_in + max_tokens * price_out) / 1e6 * 1.10


def actual_usd(reported: Column, tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return F.coalesce(reported, (tokens_in * price_in + tokens_out * price_out) / 1e6)
