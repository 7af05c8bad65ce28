"""Merging in four ways and prices against mood, with nulls and ties."""

import datetime as dt

from pyspark.sql import functions as F

from tidewright.functions import scores
from tidewright.operators import dedup


def test_merged_ways(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    rows = [
        ("a", 3, 5.0, day(1), "x"), ("a", 1, 5.0, day(3), "y"), ("a", 2, None, None, "z"),  # a tie of scores goes to the least key
        ("b", 4, None, None, "x"), ("b", 5, None, None, "x"),  # no scores and no times
        ("c", 6, 1.0, day(1), "x"), (None, 7, 9.0, day(1), "x"), (None, 8, 9.0, day(1), "x"),  # alone, and without a group
    ]
    df = spark.createDataFrame(rows, "g string, id long, score double, at timestamp, best string")  # `best` is also a name inside
    got = {(r.g, r.strategy): (r.id, r.score, r.n_merged) for r in dedup.merged_ways(df, "g", "id", "score", "at").collect()}
    assert got == {
        ("a", "higher_score"): (1, 5.0, 3), ("a", "smart"): (1, 5.0, 3), ("a", "recent"): (1, 5.0, 3), ("a", "combined"): (1, 5.0, 3),
        ("b", "higher_score"): (4, None, 2), ("b", "smart"): (4, None, 2), ("b", "recent"): (4, None, 2), ("b", "combined"): (4, None, 2),
    }
    assert dedup.merged_ways(df.limit(0), "g", "id", "score", "at").count() == 0


def test_price_divergence(spark):
    rows = [
        (1, 5.0, 2.0), (2, -4.0, 7.0), (3, 0.0, 9.5), (4, 0.0, 6.6), (5, 5.0, 9.0), (6, None, 9.9), (7, 4.0, None), (8, 3.0, 0.5), (9, -3.5, 6.5),
    ]
    d = spark.createDataFrame(rows, "id int, change double, mood double").select("id", scores.price_divergence(F.col("change"), F.col("mood")).alias("d"))
    got = {r.id: r.d and (r.d.kind, round(r.d.magnitude, 6), r.d.strength) for r in d.collect()}
    # 4: too small, 5: both rise, 6 and 7: unknown, 8: three percent are still flat, 9: 6.5 is not yet bright
    assert got == {1: ("price_leads", 80.0, "strong"), 2: ("mood_leads", 60.0, "moderate"), 3: ("anticipation", 45.0, "weak"), 4: None, 5: None, 6: None, 7: None, 8: ("anticipation", 75.0, "strong"), 9: None}
