"""Keyed state under event time: timers, restarts in the middle, and what the state store holds afterwards."""

import datetime as dt

from pyspark.sql import functions as F

from tidewright.streaming import keyed, stateful

LIFE = "key string, day_number long, status string"
KEPT = "key string, day_number long, n_kept long, n_days long"
DAY0 = dt.date(2024, 1, 1)


def number(day: int) -> int:
    return (DAY0 - dt.date(1970, 1, 1)).days + day


def levels(spark, rows):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    return spark.createDataFrame([(k, at(d), float(x)) for k, d, x in rows], "key string, day timestamp_ntz, level double")


def test_lifecycle_lifts_fades_dies_and_forgets(spark):
    rows = [("a", d, x) for d, x in enumerate((2, 2, 4, 4, 8, 8))] + [("b", 0, 1), ("c", 0, 1), ("c", 8, 9), ("z", 60, 1)]
    source = keyed.dated(levels(spark, rows), F.to_date("day"))
    got, path = keyed.run(keyed.keyed(source, ["key"], "day", keyed.Lifecycle(["key"]), LIFE), "life")
    seen = {k: [(r.day_number - number(0), r.status) for r in got.where(F.col("key") == k).orderBy("day_number", "status").collect()] for k in "abcz"}
    assert seen["a"] == [(0, "weak"), (1, "emerging"), (2, "emerging"), (3, "trending"), (4, "trending"), (5, "mainstream"), (12, "fading"), (35, "dead")]
    assert seen["b"] == [(0, "weak"), (7, "fading"), (30, "dead")]
    assert seen["c"] == [(0, "weak"), (7, "fading"), (8, "weak"), (15, "fading"), (38, "dead")]
    assert seen["z"] == [(60, "weak")]
    assert [r.key.key for r in keyed.held(spark, path, "now").select("key").collect()] == ["z"]


def test_retention_by_timers_and_across_a_restart(spark):
    rows = [("a", 0, 2), ("a", 10, 3), ("a", 65, 1), ("b", 0, 5), ("c", 100, 1)]
    df = levels(spark, rows).select("key", "day", F.col("level").cast("long").alias("n"))
    go = lambda path, state: keyed.run(
        keyed.keyed(keyed.arrivals(spark, path, df.schema), ["key"], "day", keyed.Retention(["key"]), KEPT), "kept", state
    )
    arrived = keyed.arrive(df.where("day < '2024-02-01'"), F.to_date("day"))
    got, state = go(arrived, None)
    assert got.count() == 3
    assert {r.key.key for r in keyed.held(spark, state, "kept").select("key").collect()} == {"a", "b"}
    keyed.arrive(df.where("day >= '2024-02-01'"), F.to_date("day"), arrived)
    got, _ = go(arrived, state)  # a new query, which finds the state of the one before
    seen = sorted((r.key, r.day_number - number(0), r.n_kept, r.n_days) for r in got.collect())
    assert seen == [("a", 0, 2, 1), ("a", 10, 5, 2), ("a", 65, 4, 2), ("b", 0, 5, 1), ("b", 60, 0, 0), ("c", 100, 1, 1)]
    assert {r.key.key for r in keyed.held(spark, state, "kept").select("key").collect()} == {"a", "c"}


def test_history_keeps_the_last_points_and_ends(spark):
    rows = [("a", d, d % 5) for d in range(8)] + [("b", 0, 1), ("b", 70, 3), ("z", 75, 1)]
    df = levels(spark, rows).select("key", F.datediff("day", F.lit(DAY0)).alias("id"), F.col("day").alias("at"), F.col("level").alias("value"))
    processor = keyed.History(["key"], 0.5, most=4, least=3)
    got, path = keyed.run(keyed.keyed(keyed.dated(df, F.to_date("at")), ["key"], "at", processor, "key string, id int, n_history int, smoothed double, noise_reduction double"), "history")
    by = {(r.key, r.id): r for r in got.collect()}
    assert [by["a", d].n_history for d in range(8)] == [1, 2, 3, 4, 4, 4, 4, 4]
    assert by["a", 7].smoothed == processor.smoothed([4.0, 0.0, 1.0, 2.0])[-1]
    assert by["b", 70].n_history == 1 and by["b", 70].smoothed == 3.0
    assert {r.key.key for r in keyed.held(spark, path, "points").select("key").collect()} == {"b", "z"}


def test_late_rows_inside_the_bound_count_and_others_are_dropped(spark):
    rows = [("a", 0, 1), ("a", 3, 1), ("a", 6, 1), ("a", 9, 1)]
    late = [("a", 2, 100, 3), ("a", 0, 1000, 6)]  # one day before the newest row, and six
    on_time = levels(spark, rows).withColumn("arrival", F.datediff("day", F.lit(DAY0)))
    df = on_time.unionByName(levels(spark, [r[:3] for r in late]).withColumn("arrival", F.when(F.col("level") == 100, 4).otherwise(7)))
    source = keyed.dated(df.withColumnRenamed("level", "value"), F.format_string("%02d", "arrival"))
    w = stateful.tumbling(source, "day", ["key"], "1 day", "2 days")
    got = stateful.drained(w.select("key", F.col("window.start").alias("start"), "total"), "late").collect()
    assert sorted((r.start.day - 1, r.total) for r in got) == [(0, 1.0), (2, 100.0), (3, 1.0), (6, 1.0)]


def test_fan_out_packs_do_not_lose_subscribers(spark, monkeypatch):
    monkeypatch.setattr(stateful, "PACK", 3)
    subs = [(k, ("all", "entity", "category")[k % 3], ("", "7", "x")[k % 3], ("low", "high")[k % 2]) for k in range(60)]
    packs = stateful.packed(spark.createDataFrame(subs, "subscriber int, kind string, target string, min_severity string"))
    assert packs.count() > 9
    messages = spark.createDataFrame([(1, 7, "x", "low"), (2, 7, None, "high"), (3, None, "y", None)], "message_id int, entity int, category string, severity string")
    got = {(r.message_id, r.subscriber) for r in stateful.fan_out(messages, packs).collect()}
    rank = {"low": 0, "high": 2, None: 0}
    want = {(m, s) for m, e, c, v in [(1, "7", "x", "low"), (2, "7", None, "high"), (3, None, "y", None)] for s, k, t, least in subs
            if rank[v] >= rank[least] and (k == "all" or (k == "entity" and t == e) or (k == "category" and t == c))}
    assert got == want


def test_packs_of_keys_share_one_state_and_equal_a_fold(spark):
    import random

    rnd = random.Random(5)
    rows = sorted({(k, rnd.randrange(300)) for k in [None, *"abcdefghij"] for _ in range(12)}, key=lambda r: (str(r[0]), r[1]))
    df = levels(spark, [(k, d, 1 + d % 4) for k, d in rows]).select("key", "day", F.col("level").cast("long").alias("n"))
    kept = keyed.keyed(keyed.dated(df, F.floor(F.datediff("day", F.lit(DAY0)) / 100)), ["key"], "day", keyed.Retention(["key"]), KEPT, packs=2)
    got, path = keyed.run(kept, "packs")
    want, newest = [], max(d for _, d in rows)
    for key in {k for k, _ in rows}:
        days = [d for k, d in rows if k == key]
        for d, after in zip(days, [*days[1:], None]):
            inside = [x for x in days if d - 60 < x <= d]
            want.append((key, number(d), sum(1 + x % 4 for x in inside), len(inside)))
            if after is None and d + 60 <= newest or after is not None and after - d > 60:
                want.append((key, number(d + 60), 0, 0))
    order = lambda r: (str(r[0]), *r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    assert keyed.held(spark, path, "kept").count() <= 3  # two packs and the rows without a key, for eleven keys


def test_history_of_a_pack_equals_a_fold_and_keeps_large_ids():
    import numpy as np
    import pandas as pd

    processor = keyed.History(["key"], 0.3, most=7, days=5)
    at = [(k, d) for d in range(40) for k in (1, 2, 3) if (d * k) % 5 and not (k == 3 and 10 < d < 20)]
    value = [float((7 * d + k) % 11) for k, d in at]
    df = pd.DataFrame({"key": [k for k, _ in at], "id": [2**60 + i for i in range(len(at))], "at": [pd.Timestamp(DAY0) + pd.Timedelta(days=d) for _, d in at], "value": value})
    day, old, got = lambda n: number(n) * keyed.DAY_MS, None, []
    for a, b in ((0, 9), (9, 30), (30, 40)):
        own = [a <= d < b for _, d in at]
        old, wakes, out = processor.step(old, df[own].reset_index(drop=True), day(a - 1))
        got += out.itertuples(index=False, name=None)
        assert len(old) == len(wakes) and (wakes > day(a - 1)).all()
    want, past = [], {}
    for (k, d), v, i in zip(at, value, df["id"]):
        kept = past.setdefault(k, [])
        if kept and d - kept[-1][0] >= 5:
            kept.clear()
        kept.append((d, v))
        raw = [x for _, x in kept[-7:]]
        smooth = processor.smoothed(raw) if len(raw) > 2 else raw
        want.append((k, i, len(raw), smooth[-1], 1 - np.std(smooth, ddof=1) / np.std(raw, ddof=1) if len(raw) > 2 and max(raw) > min(raw) else 0.0))
    got, want = sorted(got, key=lambda r: r[1]), sorted(want, key=lambda r: r[1])
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=1e-12)
