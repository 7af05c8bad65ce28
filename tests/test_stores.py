"""What outlives a run: the alert store under repeated delivery, the fingerprint index over several runs."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from tidewright.operators import dedup
from tidewright.operators.fingerprints import FingerprintIndex
from tidewright.streaming.alerts import AlertStore


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_alert_store_is_the_same_after_a_second_delivery(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path / "alerts"), stale_days=56, hold_days=7)
    batches = [
        [("a", "x", 1, day(0)), ("a", "x", 0, day(1)), ("b", "x", 2, day(0))],
        [("a", "x", 1, day(3))],
        [("a", "x", 3, day(5)), ("a", "y", 0, day(5))],
        [("c", "x", 0, day(60))],
        [("b", "x", 1, day(61))],
    ]
    rows = lambda df: sorted(map(str, df.collect()))
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "bucket string, kind string, level int, at timestamp_ntz")
        store.merge(df, k)
        once = rows(store.open()), rows(store.closed()), rows(store.history())
        store.merge(df, k)
        assert (rows(store.open()), rows(store.closed()), rows(store.history())) == once
        store.merge(df.limit(0), k + 100)  # nothing came: nothing changes
    alive = {(r.bucket, r.kind): r for r in store.open().collect()}
    a = alive["a", "x"]
    assert (a.level, a.first_detected, a.last_updated, a.weeks_persistent, a.n_sent) == (3, day(1), day(5), 3, 2)
    assert a.silent_until == day(12) and alive["b", "x"].weeks_persistent == 1
    assert [(r.bucket, r.expired_at) for r in store.closed().collect()] == [("b", day(60))]
    events = sorted((r.bucket, r.kind, r.at, r.event) for r in store.history().collect())
    assert events == sorted([
        ("a", "x", day(1), "created"), ("a", "x", day(3), "updated"), ("a", "x", day(5), "severity_escalated"), ("a", "x", day(5), "updated"), ("a", "y", day(5), "created"),
        ("b", "x", day(0), "created"), ("b", "x", day(60), "expired"), ("b", "x", day(61), "created"), ("c", "x", day(60), "created"),
    ])


def prints(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    out = [(0, rnd.getrandbits(64) - (1 << 63))]
    for k in range(1, n):
        f = rnd.choice(out)[1] if rnd.random() < 0.6 else rnd.getrandbits(64) - (1 << 63)
        for _ in range(rnd.randrange(5)):
            f ^= 1 << rnd.randrange(63)
        out.append((k, f))
    return out


def test_runs_over_an_index_equal_one_run(spark, tmp_path):
    rows = prints(6, 400)
    df = spark.createDataFrame([*rows, (999, None)], "key long, fingerprint long")
    path = str(tmp_path / f"index_{uuid.uuid4().hex}")
    index, got = FingerprintIndex(spark, path, buckets=4), []
    for k, (low, high) in enumerate([(0, 150), (150, 151), (151, 320), (320, 1000)]):
        got += index.run(df.where(f"key >= {low} and key < {high}"), f"2024-01-0{k + 1}").collect()
        if k == 1:  # another session knows the folder only
            spark.sql(f"DROP TABLE {index.name}")
            index = FingerprintIndex(spark, path, buckets=4)
    want = dedup.near_fingerprints(df.where("fingerprint is not null"), "key").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100


def test_the_index_is_not_shuffled_and_forgets_days(spark, tmp_path):
    df = spark.createDataFrame(prints(7, 60), "key long, fingerprint long")
    path = str(tmp_path / f"index_{uuid.uuid4().hex}")
    index = FingerprintIndex(spark, path, buckets=4)
    index.run(df.where("key < 30"), "2024-01-01")
    index.run(df.where("key >= 30 and key < 50"), "2024-02-01")
    plan = index.matches(df.where("key >= 50"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slot") == 1 and "Bucketed: true" in plan
    assert index.forget("2024-01-15") == 1
    assert [r.day for r in spark.table(index.name).select("day").distinct().collect()] == ["2024-02-01"]
    assert spark.read.parquet(path).select(F.col("day").cast("string")).distinct().count() == 1
    assert index.forget("2024-01-15") == 0
