"""Reliability, patterns of success and composites against folds written out row by row."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import composite as parts
from tidewright.operators import assessment
from tidewright.operators import timeseries as ts

CLAIM = "source string, category string, at timestamp, tie long, verified boolean, contradicted boolean, first boolean, delay double"
NOW = "2024-06-01"


def trust(claims, base):
    """One source's reliability, claim by claim."""
    n = v = x = f = 0
    last = delay = None
    cats = {}
    for _, cat, at, _, ok, bad, first, d in sorted(claims, key=lambda c: (c[2], c[3])):
        n, v, x, f = n + 1, v + bool(ok), x + bool(bad), f + bool(first)
        total, good = cats.get(cat, (0, 0))
        cats[cat] = (total + 1, good + bool(ok))
        last = at if ok else last
        delay = delay if d is None else d if delay is None else 0.3 * d + 0.7 * delay
    if n < 5:
        return base, delay
    score = base + (v / n - 0.5) * 0.4 - 0.6 * x / n + (0.1 * f / n if v / n > 0.5 else 0)
    score += sum((g / k - 0.5) * 0.15 for c, (k, g) in cats.items() if c == "price" and k >= 3)
    if last and (days := (dt.datetime.fromisoformat(NOW).date() - last.date()).days) > 30:
        keep = math.exp(-days / 90)
        score = score * keep + base * (1 - keep)
    return max(0.1, min(1.0, score)), delay


def test_reliability_equals_the_fold(spark):
    rng = random.Random(3)
    flag = lambda p: rng.choice([True, False, None]) if p is None else rng.random() < p
    rows = []
    for k, share in enumerate([0.95, 0.6, 0.1, None]):
        for i in range([400, 30, 9, 4][k]):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(140 if k else 30))
            rows.append((f"s{k}", rng.choice(["price", "staff", None]), at, i, flag(share), flag(0.1 if k else None), flag(0.3), rng.choice([None, rng.uniform(0, 90)])))
    rows.append((None, "price", dt.datetime(2024, 1, 1), 0, True, False, True, 1.0))
    bases = {"s0": 0.95, "s1": 0.7, "s2": 0.5, "s3": 0.85, "silent": 0.7}
    got = assessment.reliability(spark.createDataFrame(rows, CLAIM), spark.createDataFrame(list(bases.items()), "source string, base double"), NOW, ["price"]).collect()
    assert len(got) == len(bases)
    for r in got:
        own = [c for c in rows if c[0] == r.source]
        score, delay = trust(own, bases[r.source])
        assert (r.claims, r.verified) == (len(own), sum(bool(c[4]) for c in own))
        assert r.reliability == pytest.approx(score) and r.delay_hours == (delay if delay is None else pytest.approx(delay))
    assert {r.source: r.faded for r in got}["silent"] is False


def test_reliability_without_claims(spark):
    got = assessment.reliability(spark.createDataFrame([], CLAIM), spark.createDataFrame([("a", 0.7)], "source string, base double"), NOW, ["price"]).collect()
    assert [(r.claims, r.reliability, r.delay_hours, r.faded) for r in got] == [(0, 0.7, None, False)]


def test_last_ema_is_where_ema_ends(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, i, rng.gauss(0, 1)) for k, n in (("a", 700), ("b", 1), ("c", 40)) for i in range(n)], "k string, i int, v double")
    placed = ts.placed(df, ["k"], "i")
    want = {r.k: r.e for r in ts.ema(placed, ["k"], "v", 0.2, "e").groupBy("k").agg(F.max_by("e", "_i").alias("e")).collect()}
    got = {r.k: r.e for r in ts.last_ema(placed, ["k"], "v", 0.2, "e").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_success_patterns(spark):
    rows = [("Acme Bank", 0.95, 3, True)] * 6 + [("ACME bank", 0.95, 3, False)] * 5 + [("Ore Ltd", 0.2, 10, True)] * 2 + [(None, None, None, False)] * 3 + [("Ore Ltd", 0.5, 60, None)] * 9 + [("once", 0.7, 99, True)]
    df = spark.createDataFrame(rows, "name string, p double, days int, hit boolean")
    dims = {"entity_type": assessment.by_rules(F.col("name"), {"bank": ["bank"], "mine": ["ore", "coal"]}), "confidence": assessment.levels(F.col("p")), "timeframe": assessment.timeframes(F.col("days"))}
    got = {(r.dimension, r.pattern): (r.n, round(r.rate, 4), r.strength, r.finding) for r in assessment.success_patterns(df, F.col("hit"), dims).collect()}
    assert got == {
        ("entity_type", "bank"): (11, 0.5455, "strong", "moderate"), ("entity_type", "mine"): (2, 1.0, "weak", "reliable"), ("entity_type", "other"): (4, 0.25, "weak", "unreliable"),
        ("confidence", "very_high"): (11, 0.5455, "strong", "overconfident"), ("confidence", "low"): (2, 1.0, "weak", "underconfident"), ("confidence", "unknown"): (3, 0.0, "weak", "calibrated"),
        ("timeframe", "short_term"): (11, 0.5455, "strong", "moderate"), ("timeframe", "medium_term"): (2, 1.0, "weak", "reliable"), ("timeframe", "unknown"): (3, 0.0, "weak", "unreliable"),
    }
    assert assessment.success_patterns(df.limit(0), F.col("hit"), dims).count() == 0


def test_composite_votes_and_missing_parts(spark):
    c = F.col
    chosen = {
        "correlation": parts.correlation(c("r"), parts.significance(c("r"), c("n"))), "lead_lag": parts.lead_lag(c("power")), "buzz": parts.buzz(c("momentum"), c("pace")), "rsi": parts.rsi(c("rsi")),
        "divergence": parts.divergence(c("kind"), c("size")),
    }
    schema = "id int, r double, n int, power double, momentum double, pace string, rsi double, kind string, size double"
    rows = [
        (1, 0.8, 30, 0.5, 90.0, "accelerating", 20.0, "bullish", 0.5),
        (2, 0.5, 3, 0.05, None, None, None, None, None),  # insignificant, too weak, and nothing else
        (3, -0.8, 30, None, -20.0, "decelerating", 50.0, None, None),  # two votes against none
        (4, None, None, None, 10.0, "decelerating", 50.0, None, None),  # one vote is not enough
    ]
    got = {r.id: r for r in spark.createDataFrame(rows, schema).select("id", *[v.alias(k) for k, v in parts.composite(chosen).items()]).collect()}
    assert got[1].score == pytest.approx((0.2 * 90 + 0.15 * 50 + 0.15 * 100 + 0.1 * 20 + 0.05 * 85) / 0.65)
    assert got[1].strength == pytest.approx((0.7 + 0.8 + 0.6 + 0.6 + 0.5) / 5) and (got[1].direction, got[1].parts) == ("bullish", 5)
    assert (got[2].score, got[2].strength, got[2].direction, got[2].parts) == (50.0, 0.3, "neutral", 0)
    assert got[3].score == pytest.approx((0.2 * 10 + 0.15 * 30 + 0.1 * 50) / 0.45) and got[3].direction == "bearish"
    assert got[4].direction == "neutral"
    assert parts.tuned({"a": 0.2, "b": 0.1}, {"a": 1.0}, {"a": 1.0}) == pytest.approx({"a": 0.3, "b": 0.1})
