"""Score expressions; null rules are stated with each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_scale(v: Column, top: float) -> Column:
    """0 to 100 by the logarithm of v against that of `top`; 0 for null and negative v."""
    return F.least(100 * F.log10(F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)) + 1) / F.log10(F.lit(top + 1)), F.lit(100.0))


def bracket(v: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """The score of the first limit that v does not exceed."""
    out = F.when(v <= steps[0][0], steps[0][1])
    for limit, score in steps[1:]:
        out = out.when(v <= limit, score)
    return out.otherwise(beyond)


def recency(age_days: Column, half_life: float) -> Column:
    """Half every half_life days: 0.5 for an unknown age, 1 for the future."""
    return F.when(age_days.isNull(), 0.5).when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def freshness(age_hours: Column, half_life: float) -> Column:
    """recency() in hours, 0 beyond a week or seven half-lives, whichever is longer."""
    return F.when(age_hours > max(168.0, 7 * half_life), 0.0).otherwise(recency(age_hours, half_life))


def weighted_mean(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are not null; null if all are."""
    top = [F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()]
    low = [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()]
    return F.try_divide(sum(top[1:], top[0]), sum(low[1:], low[0]))


def coverage_penalty(present: Column) -> Column:
    """What a composite counts with, by the number of categories that it rests on."""
    return F.when(present <= 1, 0.5).when(present == 2, 0.75).when(present == 3, 0.9).otherwise(1.0)


def sigmoid_score(x: Column, power: float = 1.12) -> Column:
    """0 to 10 by the logistic function of x around 5, raised to a power."""
    return 10 * F.pow(1 / (1 + F.exp(-(x - 5))), F.lit(power))


def interpret(a: Column, b: Column, least: float) -> Column:
    """first_leads, second_leads or aligned."""
    return F.when(a - b >= least, "first_leads").when(b - a >= least, "second_leads").otherwise("aligned")


def hype_phase(technical: Column, media: Column, financial: Column) -> Column:
    """Ordered rules; the first that holds names the phase."""
    return (
        F.when((media >= 70) & (technical < 50), "peak")
        .when((media < 40) & (technical >= 60), "undervalued")
        .when((technical >= 60) & (financial >= 60), "plateau")
        .when((technical >= 40) & (media >= 40), "slope")
        .when(media >= 30, "trigger")
        .otherwise("trough")
    )


def lifecycle(level: Column, momentum: Column) -> Column:
    return F.when((level >= 60) & (momentum > 0), "scaling").when(level >= 60, "mature").when(momentum > 0, "emerging").when(momentum < 0, "declining").otherwise("steady")


def quadrant(x: Column, y: Column) -> Column:
    return F.when((x >= 50) & (y >= 50), "leaders").when(x >= 50, "builders").when(y >= 50, "talkers").otherwise("quiet")


def outcome(now: Column, then: Column, percent: float) -> Column:
    """rising, falling or flat by the change in percent; null without a base."""
    change = 100 * F.try_divide(now - then, F.when(then != 0, F.abs(then)))
    return F.when(change >= percent, "rising").when(change <= -percent, "falling").when(change.isNotNull(), "flat")


def price_divergence(change: Column, mood: Column, percent: float = 3.0, high: float = 6.5, low: float = 3.5, least: float = 40.0) -> Column:
    """A price that moves against the mood (0 to 10), as a struct of kind, magnitude and strength; null where they agree, either is unknown or the magnitude is under `least`.

    `change` is in percent. A price and a mood that point apart are price_leads or mood_leads, a flat price under
    a marked mood is anticipation. Ten points for each percent, 50 at most, and ten for each point of mood from 5 make the magnitude.
    """
    up, down, bright, dark = change > percent, change < -percent, mood > high, mood < low
    kind = F.when(up & dark, "price_leads").when(down & bright, "mood_leads").when(~up & ~down & (bright | dark), "anticipation")
    size = F.least(F.lit(50.0), F.abs(change) * 10) + 10 * F.abs(mood - 5)
    strength = F.when(size >= 70, "strong").when(size >= 50, "moderate").otherwise("weak")
    return F.when(kind.isNotNull() & (size >= least), F.struct(kind.alias("kind"), size.alias("magnitude"), strength.alias("strength")))
