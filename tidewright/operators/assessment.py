"""Judging sources and forecasts by what came of them. All counts combine before they are shuffled; no source's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import last_ema, placed


def reliability(
    claims: DataFrame, sources: DataFrame, now: str, valued: list[str], least: int = 5, quiet: int = 30, fade: float = 90.0
) -> DataFrame:
    """How far each source can be trusted: (source, claims, verified, contradicted, first_reports, base, reliability, delay_hours, faded).

    `claims` has source, category, at (timestamp), tie (orders claims of one time), verified, contradicted, first
    (booleans; null is false) and delay (hours or null). `sources` has source (no repeats) and base, and all of them are returned;
    claims of others are left out.
    Under `least` claims the base stands. Else two fifths of the verified share beyond one half are added, three fifths of
    the contradicted share taken off, a tenth of the share of first reports added if most claims are verified, and for
    each category in `valued` with three claims 0.15 of its verified share beyond one half. A source last verified over
    `quiet` days before `now` fades to its base by exp(-days / fade). The result is held within 0.1 and 1.
    delay_hours is an EMA (0.3) over its delays in order of (at, tie), null without one.
    """
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    verified_at = F.max(F.when(F.col("verified"), F.col("at")))
    per = claims.groupBy("source", "category").agg(
        F.count(F.lit(1)).alias("n"), yes("verified").alias("v"), yes("contradicted").alias("x"), yes("first").alias("f"), verified_at.alias("last")
    )
    extra = F.when(F.col("category").isin(*valued) & (F.col("n") >= 3), (F.col("v") / F.col("n") - 0.5) * 0.15)
    sums = [F.sum(c).alias(name) for c, name in zip("nvxf", ("claims", "verified", "contradicted", "first_reports"), strict=True)]
    got = per.groupBy("source").agg(*sums, F.sum(extra).alias("_extra"), F.max("last").alias("_last"))
    delays = claims.where(F.col("source").isNotNull() & F.col("delay").isNotNull()).select("source", F.struct("at", "tie").alias("_order"), "delay")
    slow = last_ema(placed(delays, ["source"], "_order"), ["source"], "delay", 0.3, "delay_hours")
    all_ = sources.select("source", "base").join(got, "source", "left").join(slow, "source", "left").fillna(0, ["claims", "verified", "contradicted", "first_reports"])
    n, v = F.col("claims"), F.try_divide(F.col("verified"), F.col("claims"))
    first = F.when(v > 0.5, 0.1 * F.col("first_reports") / n).otherwise(0.0)
    raw = F.col("base") + (v - 0.5) * 0.4 - 0.6 * F.col("contradicted") / n + first + F.coalesce("_extra", F.lit(0.0))
    days = F.datediff(F.lit(now).cast("date"), F.to_date("_last"))
    keep = F.when(days > quiet, F.exp(-days / fade)).otherwise(1.0)
    score = F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw * keep + F.col("base") * (1 - keep)))
    known = n >= least
    out = all_.withColumn("reliability", F.when(known, score).otherwise(F.col("base"))).withColumn("faded", known & F.coalesce(days > quiet, F.lit(False)))
    return out.select("source", "claims", "verified", "contradicted", "first_reports", "base", "reliability", "delay_hours", "faded")


def levels(p: Column) -> Column:
    """A confidence as very_high (0.9), high (0.7), medium (0.5) or low; null for null."""
    return F.when(p >= 0.9, "very_high").when(p >= 0.7, "high").when(p >= 0.5, "medium").when(p.isNotNull(), "low")


def timeframes(days: Column) -> Column:
    return F.when(days <= 7, "short_term").when(days <= 14, "medium_term").when(days.isNotNull(), "long_term").otherwise("unknown")


def by_rules(name: Column, rules: dict[str, list[str]]) -> Column:
    """The first kind one of whose words the name holds, whatever the case; `other` without one or for null."""
    out = F.lit("other")
    for kind, words in reversed(rules.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(name), F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    return out


def success_patterns(df: DataFrame, hit: Column, dimensions: dict[str, Column], least: int = 2) -> DataFrame:
    """(dimension, pattern, n, rate, weight, strength, finding): how often `hit` holds for each value of each dimension.

    Rows with a null hit are unresolved and left out, a null pattern is `unknown`, patterns with under `least` rows go.
    Each row is copied once for each dimension and summed before the shuffle. weight is n * |rate - 0.5|. The finding is
    by tenths of the rate; that of `confidence` (patterns as of levels()) compares it with the level's lower bound.
    """
    pairs = [F.struct(F.lit(k).alias("dimension"), F.coalesce(c, F.lit("unknown")).alias("pattern")) for k, c in dimensions.items()]
    each = df.select(hit.cast("int").alias("_hit"), F.explode(F.array(*pairs)).alias("_p")).where(F.col("_hit").isNotNull())
    g = each.groupBy("_p.dimension", "_p.pattern").agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("rate")).where(F.col("n") >= least)
    rate, due = F.col("rate"), F.when(F.col("pattern") == "very_high", 0.9).when(F.col("pattern") == "high", 0.7).when(F.col("pattern") == "medium", 0.5).otherwise(0.0)
    honest = F.when(rate < due - 0.15, "overconfident").when(rate > due + 0.15, "underconfident").otherwise("calibrated")
    plain = F.when(rate >= 0.7, "reliable").when(rate >= 0.5, "moderate").when(rate >= 0.3, "weak").otherwise("unreliable")
    strength = F.when(F.col("n") >= 10, "strong").when(F.col("n") >= 5, "moderate").otherwise("weak")
    return g.select(
        "dimension", "pattern", "n", "rate", (F.col("n") * F.abs(rate - 0.5)).alias("weight"), strength.alias("strength"),
        F.when(F.col("dimension") == "confidence", honest).otherwise(plain).alias("finding"),
    )
