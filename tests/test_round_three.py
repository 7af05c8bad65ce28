"""Queries against their SQL on small tables made for what went wrong."""

import datetime as dt
import math
import pathlib

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from tidewright.plans import ORACLE_SQL, QUERIES


def both(spark, folder, name: str, **tables: dict) -> tuple[list, list]:
    """What a query and its SQL give over tables of columns."""
    c = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet", coerce_timestamps="us")
        c.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = c.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    plain = lambda d: sorted(tuple(None if pd.isna(v) else v for v in r) for r in d.itertuples(index=False, name=None))
    return plain(got), plain(want)


def test_f9_a_similarity_that_rounds_up_to_the_threshold_counts(spark, tmp_path):
    s = 0.3999997
    e = pa.array([[1.0, 0.0], [s, math.sqrt(1 - s * s)], [-1.0, 0.1]], pa.list_(pa.float64()))
    got, want = both(spark, tmp_path, "reprint_ratios", embeddings={"vec_id": [1, 2, 3], "label": [1, 2, 3], "embedding": e})
    assert got == want and [r[1] for r in want] == [1, 1, 0]


def test_f4_what_a_stream_delivers_does_not_grow_with_subscribers(spark, tmp_path):
    from tidewright.sources.tables import shared_folder

    n = 600
    events = {"event_id": range(40), "user_id": [k % 10 for k in range(40)], "event_type": [("error", "purchase", "click")[k % 3] for k in range(40)]}
    events |= {"value": [float(50 + 4 * k) for k in range(40)], "ts": [dt.datetime(2024, 1, 1 + k % 20) for k in range(40)]}
    before = {str(p) for p in pathlib.Path(shared_folder(spark)).glob("fan-out-*")}
    got, want = both(spark, tmp_path, "s_fan_out", events={c: list(v) for c, v in events.items()}, customer={"c_custkey": list(range(n))})
    assert got == want and len(got) > 200
    (new,) = {str(p) for p in pathlib.Path(shared_folder(spark)).glob("fan-out-*")} - before
    assert spark.read.parquet(f"{new}/out").count() <= 9 * 40


def test_f10_alerts_whose_short_hashes_meet_are_counted_apart(spark, tmp_path):
    first, second = dt.datetime(1995, 3, 1), dt.datetime(1995, 8, 1)  # 113880|1|1995-03-01 and 131739|1|1995-03-01 have MD5s that begin with ab105d78
    keys, days, prices = [113880, 113880, 131739, 131739, 7], [first, second, first, second, first], [50_000.0, 150_000.0, 50_000.0, 60_000.0, 1.0]
    got, want = both(spark, tmp_path, "s_alert_store", orders={"o_orderkey": [*range(5)], "o_custkey": keys, "o_orderdate": days, "o_orderpriority": ["1-URGENT"] * 5, "o_totalprice": prices})
    assert got == want and len(got) == 3


def test_f8_amounts_of_half_a_cent_go_up(spark, tmp_path):
    prices = [float(k) for k in range(100_500, 300_000, 1000)] + [99_999.99, 123_456.78]
    n = len(prices)
    orders = {"o_orderkey": [*range(n)], "o_custkey": [1] * n, "o_totalprice": prices}
    customer, nation = {"c_custkey": [1], "c_name": ["Acme"], "c_nationkey": [1]}, {"n_nationkey": [1], "n_name": ["PERU"]}
    got, want = both(spark, tmp_path, "funding_details", orders=orders, customer=customer, nation=nation)
    assert got == want and [r[1] for r in got[:3]] == [1_010_000.0, 1_020_000.0, 1_030_000.0]


def test_f14_first_words_are_found_in_their_row(spark, tmp_path):
    texts = ["b a b c", "One two, ONE 3three", "", None, " ".join(chr(97 + k % 26) * (1 + k % 3) for k in range(60))]
    got, want = both(spark, tmp_path, "first_seen_words", documents={"doc_id": [*range(5)], "text": texts})
    assert got == want and len(got) == 16
    assert "Exchange" not in QUERIES["first_seen_words"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_f2_signatures_rule_out_sets_that_meet_but_are_far_apart(spark):
    import random

    from tidewright.operators import dedup
    from tidewright.sources.tables import shared_folder

    rnd = random.Random(3)
    base = [rnd.sample(range(150), 70) for _ in range(150)]  # few items: nearly all sets meet in their prefixes
    sets = base + [[*s[1:], 151 + k] for k, s in enumerate(base[:40])]
    before = {str(p) for p in pathlib.Path(shared_folder(spark)).glob("candidates-*")}
    got = {(r.a, r.b) for r in dedup.jaccard_pairs(spark.createDataFrame(list(enumerate(sets)), "id int, s array<int>"), "id", "s", 0.7).collect()}
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    assert got == {(b, a) for a, b in pairs if len({*sets[a]} & {*sets[b]}) >= 0.7 * len({*sets[a]} | {*sets[b]})} and len(got) >= 40
    (new,) = {str(p) for p in pathlib.Path(shared_folder(spark)).glob("candidates-*")} - before
    assert spark.read.parquet(new).count() <= 2 * len(got)


def test_f11_clusters_of_equal_names_have_their_parents(spark, tmp_path):
    say = lambda tag, names: " ".join(f"{tag * 4}{c}word {name}" for c, name in zip("abcdef", names * 2)) + "."
    texts = [say("xy", ["Aaa", "Bbb"])] * 2 + [say("zw", ["Aaa", "Bbb"])] * 2 + [say("uv", ["Aaa", "Bbb", "Ccc"])] * 3
    got, want = both(spark, tmp_path, "meta_signals", documents={"doc_id": [*range(7)], "text": texts})
    assert got == want and [r[5] for r in want] == [4, 4, None]


def test_f5_life_cycles_take_few_micro_batches(spark):
    from tidewright.sources.tables import shared_folder

    before = set(pathlib.Path(shared_folder(spark)).glob("arrivals-*"))
    QUERIES["s_lifecycles"](spark, "/root/testdata/sf0.001")
    (new,) = set(pathlib.Path(shared_folder(spark)).glob("arrivals-*")) - before
    assert 1 < len(list(new.glob("period=*"))) <= 6


def test_f13_windows_of_fingerprints_do_not_become_rows(spark, tmp_path):
    some = ["Alpha beta gamma, delta! alpha BETA gamma; alpha-beta gamma", "ab cd", "one", "two words", "Straße über Öl 123 4567 straße", "", None, "x" * 300 + " y22 zed " * 40, "\n".join(f"line {k} of one long text" for k in range(400))]
    ids = [*range(8), 8, 8, -1, 3]  # equal keys vote together
    got, want = both(spark, tmp_path, "simhash_fingerprints", documents={"doc_id": ids, "text": [*some, "nine other words here", "a key below zero has words", "and key three again"]})
    assert got == want and len(got) == 8
    plan = QUERIES["simhash_fingerprints"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
