"""Signals of one entity as parts of a composite: each has a score, a confidence and votes, and one without a score is left out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import weighted_mean

#: The weight of each part and the score of each trend.
WEIGHTS = {"correlation": 0.20, "lead_lag": 0.15, "buzz": 0.15, "funding": 0.15, "rsi": 0.10, "trend": 0.10, "volume": 0.10, "divergence": 0.05}
TREND_SCORES = {"strong_bullish": 90, "bullish": 70, "consolidating": 50, "bearish": 30, "strong_bearish": 10}


class Part(NamedTuple):
    score: Column
    sure: Column
    up: Column
    down: Column


def never() -> Column:
    return F.lit(False)


def held(v: Column) -> Column:
    """v within 0 to 100; null stays null."""
    return F.when(v < 0, 0.0).when(v > 100, 100.0).otherwise(v)


def significance(r: Column, n: Column) -> Column:
    """high, medium or low by the t value of a correlation of n pairs; low without one."""
    t = F.abs(r) * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-12)))
    return F.when((n > 2) & (t > 2.576), "high").when((n > 2) & (t > 1.96), "medium").otherwise("low")


def correlation(r: Column, level: Column) -> Part:
    """Insignificant correlations are left out."""
    return Part(F.when(level != "low", (r + 1) * 50), F.when(level == "high", 0.7).otherwise(0.5), r > 0.2, r < -0.2)


def lead_lag(power: Column) -> Part:
    """`power` is the correlation with what follows; it says nothing of the direction."""
    return Part(F.when(power > 0.1, power * 100), F.least(power + 0.3, F.lit(0.8)), never(), never())


def buzz(momentum: Column, trend: Column) -> Part:
    return Part(held(50 + momentum), F.lit(0.6), trend == "accelerating", trend == "decelerating")


def funding(relative: Column, raising: Column) -> Part:
    """`relative` is the rate against the sector's, 0 for its own mean."""
    return Part(held(50 + 25 * relative), F.when(raising, 0.7).otherwise(0.4), raising, never())


def rsi(value: Column) -> Part:
    """Against the crowd: 70 and more is bearish, 30 and less bullish."""
    return Part(value, F.abs(value - 50) / 50, value <= 30, value >= 70)


def trend(name: Column, golden: Column, death: Column) -> Part:
    score = F.coalesce(*[F.when(name == k, float(v)) for k, v in TREND_SCORES.items()])
    return Part(score, F.when(golden | death, 0.7).otherwise(0.5), golden | name.isin("bullish", "strong_bullish"), death | name.isin("bearish", "strong_bearish"))


def volume(mean: Column, gap: Column) -> Part:
    """`mean` is on 0 to 10 and weighted by volume, `gap` what the weights change."""
    return Part(mean * 10, F.lit(0.65), gap > 0.5, gap < -0.5)


def divergence(kind: Column, size: Column) -> Part:
    up, down = kind == "bullish", kind == "bearish"
    return Part(F.when(up, 70 + 30 * size).when(down, 30 - 30 * size).when(kind.isNotNull(), 50.0), size, up, down)


def tuned(weights: dict[str, float], past: dict[str, float], recent: dict[str, float]) -> dict[str, float]:
    """Weights scaled by accuracy, three fifths of it long past; a half where none is known leaves a weight as it is."""
    return {k: w * (0.5 + 0.6 * past.get(k, 0.5) + 0.4 * recent.get(k, 0.5)) for k, w in weights.items()}


def composite(parts: dict[str, Part], weights: dict[str, float] = WEIGHTS) -> dict[str, Column]:
    """score, strength, direction and parts (how many count).

    The score is the weighted mean (50 without parts), the strength the mean confidence (0.3 without).
    One side must have two votes more than the other, else the direction is neutral.
    """
    here = {k: p.score.isNotNull() for k, p in parts.items()}
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    count = sum((one(h) for h in here.values()), F.lit(0))
    sure = sum((F.when(here[k], F.coalesce(p.sure, F.lit(0.0))).otherwise(0.0) for k, p in parts.items()), F.lit(0.0))
    up = sum((one(here[k] & p.up) for k, p in parts.items()), F.lit(0))
    down = sum((one(here[k] & p.down) for k, p in parts.items()), F.lit(0))
    return {
        "score": F.coalesce(weighted_mean({k: (p.score, weights[k]) for k, p in parts.items()}), F.lit(50.0)),
        "strength": F.coalesce(F.try_divide(sure, count), F.lit(0.3)),
        "direction": F.when(up > down + 1, "bullish").when(down > up + 1, "bearish").otherwise("neutral"),
        "parts": count,
    }
