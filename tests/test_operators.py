"""Hand-computed rows for operators, and brute force for pair searches."""

import datetime as dt
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import scores, text
from tidewright.operators import dedup, filters, graphs, joins, statistics, timeseries
from tidewright.sources import sinks, tables


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_q02_q12_conditions_nest(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, "a", 9.0)], "id int, k string, v double")
    c = filters.condition(df, {"or": [{"not": {"field": "k", "op": "=", "value": "a"}}, {"field": "v", "op": "between", "value": [8, 10]}]})
    assert [r.id for r in df.where(c).orderBy("id").collect()] == [2, 3]
    assert df.where(filters.condition(df, {"field": "v", "op": "is null"})).count() == 1
    with pytest.raises(ValueError):
        filters.condition(df, {"field": "v; drop", "op": "=", "value": 1})
    with pytest.raises(ValueError):
        filters.compare(F.col("v"), "~", 1)


def test_q28_q29_missing_signals_are_false(spark):
    df = spark.createDataFrame([(None,), (3.0,)], "a double")
    rule = {"logic": "OR", "conditions": [{"signal": "a", "op": ">", "value": 2}, {"signal": "gone", "op": ">", "value": 0}, {"logic": "AND", "conditions": []}]}
    assert [r[0] for r in df.select(filters.rule_tree(rule, {"a": F.col("a")})).collect()] == [False, True]


def test_j01_latest_keeps_ties(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 2, "z"), (2, 1, "w")], "k int, t int, v string")
    assert values(joins.latest(df, ["k"], "t").select("k", "v"), "k", "v") == [(1, "y"), (1, "z"), (2, "w")]
    assert joins.latest(df, ["k"], "t", ties=False).count() == 2


def test_j10_pairs_within_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(4), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(20000))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k int, at timestamp_ntz")
    got = {(r.id_l, r.id_r) for r in joins.pairs_within(df, df, "k", "at", 2).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and dt.timedelta(0) < b[2] - a[2] <= dt.timedelta(days=2)}


def test_w32_w33_islands_and_numbering(spark):
    df = spark.createDataFrame([(1, i, g) for i, g in enumerate([True, True, False, True, None, True])], "k int, i int, g boolean")
    assert [r.n for r in joins.islands(df, ["k"], "i", F.col("g"), "n").orderBy("i").collect()] == [1, 2, 0, 1, 0, 1]
    many = spark.range(1000).select((F.lit(999) - F.col("id")).alias("x"))
    assert all(r.x == r.n for r in joins.numbered(many, ["x"], "n").collect())


def test_w03_daily_fills_gaps(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 5), 1.0), (1, dt.datetime(2024, 1, 1, 7), 2.0), (1, dt.datetime(2024, 1, 4), 5.0)]
    got = values(timeseries.daily(spark.createDataFrame(rows, "k int, at timestamp_ntz, v double"), ["k"], "at", "v").select("v", "filled", "day"), "day")
    assert [g[:2] for g in got] == [(2.0, False), (2.0, True), (2.0, True), (5.0, False)]


def test_w14_rsi_short_and_rising(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "k int, i int, v double")
    got = [r.rsi for r in timeseries.rsi("v", ["k"], "i")(df).orderBy("i").collect()]
    assert got[0] == 50.0 and got[13] == 50.0 and got[19] == 100.0


def test_w04_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(8)], "k string, i int, x double, y double")
    assert all(r.r is None for r in df.select(timeseries.pearson("x", "y", timeseries.last_rows(["k"], "i", 5), 3).alias("r")).collect())


@pytest.mark.parametrize(("alpha", "seed"), [(0.5, 1), (0.3, 4), (0.999, 3), (0.02, 12), (1.0, 1)])
def test_w11_w12_scans_equal_folds(spark, alpha, seed):
    rnd = random.Random(seed)
    series = {"a": [rnd.uniform(-1e6, 1e6) for _ in range(900)], "b": [rnd.random() for _ in range(seed)], "c": [1.0] * max(1, seed - 1), "d": [10.0 ** (k % 9) for k in range(300)]}
    df = spark.createDataFrame([(k, i * 3, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, t int, v double").repartition(7)
    got = {(r.k, r.t // 3): r.e for r in timeseries.ema(timeseries.placed(df, ["k"], "t"), ["k"], "v", alpha, "e", seed).collect()}
    assert len(got) == sum(map(len, series.values()))
    for k, vs in series.items():
        now = None
        for i, v in enumerate(vs):
            if i >= seed:
                now = alpha * v + (1 - alpha) * now
            elif i == seed - 1:
                now = sum(vs[:seed]) / seed
            assert got[k, i] is None if now is None else got[k, i] == pytest.approx(now, rel=1e-9, abs=1e-6)


def test_w13_clipped_at_sorted_places(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (9, 1, 5, 3, 7, 100, -50, 4, 4, 6)] + [("b", 2.0)], "k string, v double")
    got = [r.c for r in timeseries.clipped(df, ["k"], "v", 0.1, 0.9, "c").orderBy("k", "v").collect()]
    assert got == [1.0, 1.0, 3.0, 4.0, 4.0, 5.0, 6.0, 7.0, 9.0, 100.0, 2.0]


@pytest.mark.parametrize(("n", "share"), [(40, 0.1), (60, 0.03), (30, 0.6)])
def test_d18_leaders_equal_the_fold(spark, n, share):
    rnd = random.Random(n)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < share] + [(k, k + 1) for k in range(n, n + 30)]
    rows = spark.createDataFrame([(k,) for k in range(n + 40)], "k int")
    leader = {}
    for k in range(n + 40):
        leader[k] = min((a for a, b in pairs if b == k and leader[a] == a), default=k)
    got, rounds = graphs.greedy_leaders(rows, "k", spark.createDataFrame(pairs, "a int, b int"))
    assert {r.id: r.leader for r in got.collect()} == leader and 0 < rounds <= 17
    none, rounds = graphs.greedy_leaders(rows, "k", spark.createDataFrame([], "a int, b int"))
    assert rounds == 0 and none.where("id <> leader").count() == 0


@pytest.mark.parametrize("least", [0.28, 0.55, 0.7, 1.0])
def test_d15_overlap_at_thresholds_that_doubles_miss(spark, least):
    rnd = random.Random(8)
    sets = [frozenset(rnd.sample(range(30), 25)) for _ in range(12)] + [frozenset(range(25)), frozenset(range(7)), frozenset(range(25, 50)), frozenset(range(14, 25))]
    sets += [frozenset(range(100, 200)), frozenset(range(100, 128)), frozenset(range(100, 155)), frozenset(range(300, 350)), frozenset(range(300, 314)), frozenset(range(25))]
    df = spark.createDataFrame([(k, sorted(map(str, s))) for k, s in enumerate(sets)], "k int, s array<string>")
    got = {(r.a, r.b) for r in dedup.jaccard_pairs(df, "k", "s", least).collect()}
    rep = {}
    for k, s in enumerate(sets):
        rep.setdefault(s, k)
    want = {(rep[s], k) for k, s in enumerate(sets) if rep[s] != k}
    want |= {(j, k) for (s, j), (t, k) in itertools.combinations(sorted(rep.items(), key=lambda x: x[1]), 2) if round(100 * least) * len(s | t) <= 100 * len(s & t)}
    assert got == want


def test_v01_student_t(spark):
    df = spark.createDataFrame([(0.5, 20), (1.0, 5), (0.3, 2)], "r double, n int")
    p = [r[0] for r in df.select(statistics.t_p_value(F.col("r"), F.col("n"))).collect()]
    assert p[0] == pytest.approx(0.0247707, abs=1e-5) and p[1] == 0.0 and (p[2] is None or math.isnan(p[2]))


def test_v03_v10_v14_bins(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.3, 0.5, 0.7, 0.85, 1.0)], "p double")
    assert [r[0] for r in df.select(statistics.edge_bin(F.col("p"), [0, 0.3, 0.5, 0.7, 0.85, 1.0])).collect()] == [0, 1, 2, 3, 4, 4]
    assert [r[0] for r in df.select(statistics.equal_width(F.col("p"), 10)).collect()] == [0, 3, 5, 7, 8, 9]
    low, high = spark.range(1).select(*statistics.wilson(F.lit(8), F.lit(10))).first()
    assert low == pytest.approx(0.49016, abs=1e-4) and high == pytest.approx(0.94331, abs=1e-4)


def test_d07_d10_simhash_pairs_match_all_pairs(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(63) for _ in range(40)]
    prints = base + [b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base] + base[:5]
    df = spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint long")
    got = {(r.a, r.b) for r in dedup.near_fingerprints(df, "id").collect()}
    groups = {}
    for i, p in enumerate(prints):
        groups.setdefault(p, []).append(i)
    want = {(g[0], x) for g in groups.values() for x in g[1:]}
    for (p, g), (q, h) in itertools.combinations(groups.items(), 2):
        if (p ^ q).bit_count() <= 3:
            want.add((min(g[0], h[0]), max(g[0], h[0])))
    assert got == want


def test_d14_d15_ratios(spark):
    assert dedup.common_length("kitten", "sitting") == 4 and dedup.common_length("", "a") == 0
    df = spark.createDataFrame([("b a", "A B"), ("x", None)], "s string, t string")
    got = [r[0] for r in df.select(dedup.edit_ratio(F.col("s"), F.col("t"), True)).collect()]
    assert got[0] == 1.0 and (got[1] is None or math.isnan(got[1]))
    rnd = random.Random(2)
    sets = [(i, rnd.sample(range(30), rnd.randrange(1, 12))) for i in range(60)]
    got = {(r.a, r.b) for r in dedup.jaccard_pairs(spark.createDataFrame(sets, "id int, s array<int>"), "id", "s", 0.5).collect()}
    first = {}
    for i, x in sets:
        first.setdefault(frozenset(x), i)
    own = [(i, x) for i, x in sets if first[frozenset(x)] == i]  # equal sets count as one
    want = {(a[0], b[0]) for a, b in itertools.combinations(own, 2) if len({*a[1]} & {*b[1]}) >= 0.5 * len({*a[1]} | {*b[1]})}
    assert want <= got


def test_g01_components_and_g12_spread(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 4), (5, 6)] + [(i, i + 1) for i in range(10, 30)]
    got = {r.id: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[6] == 5 and got[30] == 10 and 4 not in got
    e = spark.createDataFrame([(1, 2, 0.5, 1), (2, 3, 0.5, 1), (1, 3, 0.1, 5), (3, 4, 1.0, 1)], "src long, dst long, strength double, lag int")
    s = spark.createDataFrame([(1, 1, 10.0)], "origin long, node long, impact double")
    got = {r.node: (r.hop, round(r.impact, 6)) for r in graphs.spread(e, s).collect()}
    assert got[3] == (1, 0.7) and got[2] == (1, 3.5) and got[4][0] == 2


def test_g12_wide_spreading_equals_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(graphs, "LANES", 4)
    rnd = random.Random(9)
    edges = {(rnd.randrange(40), rnd.randrange(40)): round(rnd.uniform(-1, 1), 3) for _ in range(160)} | {(0, k): 0.0 for k in range(40, 44)}
    e = spark.createDataFrame([(a, b, s, 1) for (a, b), s in edges.items()], "src long, dst long, strength double, lag int")
    starts = spark.createDataFrame([(k, k % 20, float(k + 1)) for k in range(11)] + [(3, 30, -2.0), (3, 3, 0.5)], "origin long, node long, impact double")
    once = starts.groupBy("origin", "node").agg(F.max_by("impact", F.abs("impact")).alias("impact"))
    got, origins = graphs.spread_wide(e, starts)
    seen = {(r.origin, r.node): (r.hop, round(abs(r.impact), 9)) for r in got.join(origins, "k").collect()}
    assert seen == {(r.origin, r.node): (r.hop, round(abs(r.impact), 9)) for r in graphs.spread(e, once).collect()}


def test_g12_wide_spreading_in_many_groups_and_over_a_node_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(graphs, "LANES", 5)
    monkeypatch.setattr(graphs, "GROUP_EDGES", 40)
    rnd, far = random.Random(11), 2**60
    ends = {(0, k): rnd.uniform(-1, 1) for k in range(1, 601)} | {(k, 601): rnd.uniform(-1, 1) for k in range(1, 601)} | {(601, 602 + k % 7): rnd.uniform(-1, 1) for k in range(30)}
    e = spark.createDataFrame([(far + a, far + b, round(s, 3), 1) for (a, b), s in ends.items()], "src long, dst long, strength double, lag int")
    starts = spark.createDataFrame([(k, far + 13 * k, float(k + 1)) for k in range(9)], "origin long, node long, impact double")
    got, origins = graphs.spread_wide(e, starts)
    seen = {(r.origin, r.node): (r.hop, round(abs(r.impact), 9)) for r in got.join(origins, "k").collect()}
    assert seen == {(r.origin, r.node): (r.hop, round(abs(r.impact), 9)) for r in graphs.spread(e, starts).collect()}


def test_d13_vectors_match_brute_force(spark):
    rnd = random.Random(1)
    v = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(50)] + [(50, [1.0, 0.0, 0.0, 0.0]), (51, [1.0, 0.0, 0.0, 0.0])]
    got = {(r.a, r.b) for r in graphs.near_vectors(spark.createDataFrame(v, "id long, e array<double>"), "id", "e", 0.8, block=16).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    want = {(a[0], b[0]) for a, b in itertools.combinations(v, 2) if cos(a[1], b[1]) >= 0.8}
    assert {p for p in want if 51 not in p or p == (50, 51)} == got


def test_f01_f06_text(spark):
    urls = ["https://www.Ex.com/a/?utm_source=x&b=1#f", "http://ex.com/a?b=1&ref=q", "nohost", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(text.canonical(F.col("u")), text.host(F.col("u"))).collect()]
    assert got[0] == ("ex.com/a?b=1", "ex.com") and got[1] == ("ex.com/a?b=1", "ex.com") and got[2][1] == got[3][1] == "unknown"
    names = spark.createDataFrame([("Acme, Inc.",), ("  Foo & Bar GmbH",)], "n string").select(text.entity_id(F.col("n"))).collect()
    assert [n[0] for n in names] == ["acme", "foo-bar"]
    money = spark.createDataFrame([("raised $2.5 million",), ("$3bn",), ("none",)], "t string").select(text.amount(F.col("t"))).collect()
    assert [m[0] for m in money] == [2.5e6, 3e9, None]


def test_f14_f15_scores(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (7.0,), (400.0,)], "a double")
    got = df.select(scores.recency(F.col("a"), 7.0), scores.freshness(F.col("a"), 24.0)).collect()
    assert [r[0] for r in got[:3]] == [0.5, 1.0, 0.5] and got[3][1] == 0.0
    none = spark.range(1).select(scores.weighted_mean({"a": (F.lit(None).cast("double"), 0.5)})).first()[0]
    assert none is None


def test_s03_s24_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, w int"), spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k int, v string, w int")
    assert values(sinks.upsert(old, new, "k"), "k") == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert sinks.canonical_json({"b": 1.0, "a": [0.1, -0.0]}) == '{"a":[0.1,0],"b":1}'
    with pytest.raises(ValueError):
        sinks.canonical_json(float("nan"))
    chain = sinks.hash_chain(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "l int, i int, v string"), "l", "i").orderBy("i").collect()
    assert chain[1].prev_hash == chain[0].entry_hash
    for kind in ("csv", "json", "parquet"):
        sinks.export(old, f"{tmp_path}/{kind}", kind, "gzip")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert [json.loads(x)["k"] for x in sinks.streamed(old)] == [1, 2]
    rows, info = sinks.page(old, [F.col("k")], 2, 1)
    assert rows.first().k == 2 and info["total_pages"] == 2 and not info["has_next"]


def test_s06_day_files(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"signals_{day}.json").write_text('{"a": 1}\n{"a": broken\n')
    got = tables.day_files(spark, f"{tmp_path}/*.json", "a int", first="2024-01-02").collect()
    assert len(got) == 2 and sum(r._corrupt_record is not None for r in got) == 1


def test_f23_funding_details(spark):
    rows = ["Acme raises $1,250.5 million Series B led by Blue Sky Capital today", "pre-seed of $3bn", "$40K, growth", "nothing", None]
    got = [r.f for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(text.funding(F.col("t")).alias("f")).collect()]
    assert [(f.amount_usd, f.stage, f.lead_investor) for f in got] == [
        (1_250_500_000.0, "series_b", "Blue Sky Capital"), (3e9, "pre_seed", None), (40_000.0, "growth", None), (None, "unknown", None), (None, "unknown", None),
    ]


def test_g18_relationships_by_direction_kind_and_day(spark):
    day = lambda d: dt.date(2024, 1, d) if d else None
    rows = [("a", "b", "owns", day(1), day(9)), ("b", "c", "owns", day(5), None), ("a", "c", "buys", None, day(3)), ("a", "a", "owns", None, None)]
    e = spark.createDataFrame(rows, "source string, target string, kind string, since date, until date")
    take = lambda *a, **k: sorted((r.id, r.other, r.kind, r.direction) for r in graphs.relationships(e, *a, **k).collect())
    assert take("outgoing", "owns", "2024-01-04") == [("a", "a", "owns", "outgoing"), ("a", "b", "owns", "outgoing")]
    assert take("incoming", day="2024-01-20") == [("a", "a", "owns", "incoming"), ("c", "b", "owns", "incoming")]
    assert len(take()) == 8


def test_j02_either_key_keeps_each_left_row_once(spark):
    left = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 6, "a"), (7, 2, "d"), (8, 2, "c")], "first int, second int, v string")
    assert values(joins.either_key(left, right, "k", "first", "second", "v"), "k") == [(1, "a"), (2, "c"), (9, None)]


def test_j11_first_after_at_any_time_of_day(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, at(1, 8)), (1, at(4, 0)), (2, at(1, 8)), (3, at(1, 8))], "k int, t timestamp")
    right = spark.createDataFrame([(1, at(1, 20), 5.0), (1, at(3, 9), 6.0), (1, at(3, 9), 5.5), (2, at(4, 8), 7.0), (3, at(4, 9), 8.0)], "k int, t timestamp, v double")
    got = [(r.k, r.v, r.lag_days) for r in joins.first_after(left, right, "k", "t", "v", 3).orderBy("k", "t").collect()]
    assert got == [(1, 5.0, 0), (1, None, None), (2, 7.0, 3), (3, None, None)]


def test_d14_edit_ratio_pairs_match_brute_force(spark):
    rnd = random.Random(3)
    words = ["red", "reed", "rod", "steel", "steal", "brass", "bras", "bolt", "bolts"]
    rows = [(i, "b", " ".join(rnd.choices(words, k=3))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, brand string, name string")
    got = {(r.a, r.b) for r in dedup.near_in_block(df, "k", ["brand"], "name", 0.85).collect()}
    key = {i: " ".join(sorted(n.split())) for i, _, n in rows}
    rep = {}
    for i in sorted(key):
        rep.setdefault(key[i], i)
    want = {(rep[key[i]], i) for i in key if rep[key[i]] != i}
    for (s, a), (t, b) in itertools.combinations(rep.items(), 2):
        if 2 * dedup.common_length(s, t) >= 0.85 * (len(s) + len(t)):
            want.add((min(a, b), max(a, b)))
    assert got == want


def test_s23_ledgers_in_many_batches(spark):
    rows = [(k % 3, k, f"v{k}") for k in range(200)]
    got = sinks.hash_chain(spark.createDataFrame(rows, "l int, i int, v string").repartition(7), "l", "i").collect()
    for ledger in range(3):
        own = sorted((r for r in got if r.l == ledger), key=lambda r: r.i)
        assert own[0].prev_hash == "0" * 64 and all(b.prev_hash == a.entry_hash for a, b in itertools.pairwise(own))


def test_d06_near_in_time_equals_brute_force(spark):
    r, at = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(k, r.choice("uv"), at + dt.timedelta(hours=r.randrange(0, 240, 6)), r.choice(["alpha one", "alpha two", "alpha on", "beta", "", None])) for k in range(120)]
    rows.append((200, "u", None, "beta"))
    df = spark.createDataFrame(rows, "k int, who string, at timestamp_ntz, name string")
    got = {(r.a, r.b): round(r.similarity, 6) for r in dedup.near_in_time(df, "k", ["who"], "at", "name", 1, 0.7).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for a, b in itertools.permutations([x for x in rows if x[2] is not None and x[3] is not None], 2):
        if a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]) and b[2] - a[2] <= dt.timedelta(days=1):
            longer = max(len(a[3]), len(b[3]))
            s = 1 - edits(a[3], b[3]) / longer if longer else 1.0
            if s >= 0.7:
                want[a[0], b[0]] = round(s, 6)
    assert got == want and len(want) > 50


def test_g20_tiers_deny_ambiguity_and_nulls(spark):
    names = spark.createDataFrame([("Northwind", 1), ("Southwind", 2), ("Acme 1", 3), ("Acme 2", 4)], "name string, target long")
    m = spark.createDataFrame([(1, "Northwind"), (2, "northwnd"), (3, "Acme x"), (4, "spam"), (5, None), (6, ""), (7, "nothing like it")], "k int, name string")
    out = joins.tiers(m, "name", [("name", "name", names, 1.0)], names, ["spam"], 0.8, 0.9)
    got = {r.k: (r.target, r.tier, round(r.confidence, 3)) for r in out.collect()}
    assert got == {1: (1, "name", 1.0), 2: (1, "fuzzy", 0.889), 3: (None, "ambiguous", 0.0), 4: (None, "denied", 0.0), 5: (None, "none", 0.0), 6: (None, "none", 0.0), 7: (None, "none", 0.0)}
    assert joins.tiers(m.limit(0), "name", [("name", "name", names, 1.0)], names, [], 0.8, 0.9).count() == 0


def test_g13_warnings_turn_round_with_the_correlation(spark):
    changes = spark.createDataFrame([("a", 2.0), ("b", -1.0), ("c", 0.0)], "leader string, c double")
    leads = spark.createDataFrame([("a", "x", 3, 0.5, 30), ("a", "y", 1, -0.5, 10), ("b", "x", 2, 0.9, 30), ("b", "z", 2, 0.2, 30)], "leader string, target string, lag int, r double, n int")
    got = values(graphs.warnings_of(changes, leads, 0.3).select("leader", "target", "direction", "expected", "confidence"), "leader", "target")
    assert got == [("a", "x", "positive", "positive", "high"), ("a", "y", "positive", "negative", "medium"), ("b", "x", "negative", "negative", "high")]


def test_w25_normal_share(spark):
    zs = [-7.0, -2.5, -1.0, 0.0, 0.3, 1.96, 5.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", statistics.normal_below(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-max(r.z, -6.0) / math.sqrt(2))) < 1e-12 for r in got)


def test_u04_parts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, float(k)) for k in range(300)], "k int, v double")
    sums = lambda n: {r.k: (r.s0, r.s1) for r in statistics.by_parts(df.repartition(n), ["k"], "v", lambda v: [v.sum(), len(v)], 2).collect()}
    assert sums(1) == sums(13) and sums(1)[None][1] == 43
    assert statistics.by_parts(df.limit(0), ["k"], "v", lambda v: [v.sum(), len(v)], 2).count() == 0


def test_u03_predictions_see_only_training_sums(spark):
    y = statistics.walk_forward(spark.createDataFrame([(k, float(k)) for k in range(20)], "k int, v double"), ["k"], 20, folds=2)
    got = statistics.called_forward(y, [F.max("v").alias("top")], lambda rows: rows.v - rows.top).collect()
    assert all(r.prediction == r.v - r.top > 0 for r in got) and {r.fold for r in got} == {0, 1}


def test_f03_kinds_and_x11_replay(spark):
    d = spark.createDataFrame([("Big GEAR works",), ("bolt gear",), ("plain",), (None,)], "n string")
    kinds = {"machine": ("gear",), "fastener": ("bolt",)}
    assert [r[0] for r in d.select(text.kind_of(F.col("n"), kinds, "company")).collect()] == ["machine", "machine", "company", "company"]
    feeds = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5), ("a", dt.date(2024, 1, 6), 1), ("b", dt.date(2024, 1, 2), 2)], "k string, day date, n long")
    got = [tuple(r)[1:] for r in joins.replay(feeds, "k", "day", "n", 3).orderBy("day").collect()]
    assert got == [(1, 0, 1, 5), (1, 1, 0, 7), (0, 2, 0, 7), (0, 2, 0, 7), (0, 1, 1, 2), (1, 0, 1, 1)]
    assert joins.replay(feeds.limit(0), "k", "day", "n", 3).count() == 0


def test_s06_day_files_by_folder(spark, tmp_path):
    spark.createDataFrame([("2024-01-01", 1), ("2024-01-03", 2), ("2024-01-09", 3)], "day string, v int").write.partitionBy("day").json(str(tmp_path / "in"))
    got = values(tables.day_files(spark, str(tmp_path / "in" / "*"), "v int", "2024-01-02", "2024-01-05").select("v", F.col("day").cast("string")), "v")
    assert got == [(2, "2024-01-03")]


def test_d10_a_text_finds_its_nearest_earlier_one(spark):
    r = random.Random(8)
    base = [r.getrandbits(62) for _ in range(6)]
    prints = [(k, base[k % 6] ^ (1 << r.randrange(62) if k % 4 else 0)) for k in range(40)]
    pairs = dedup.near_fingerprints(spark.createDataFrame(prints, "doc_id long, fingerprint long"), "doc_id")
    got = {r.b: (r.d, r.a) for r in pairs.groupBy("b").agg(F.min("distance").alias("d"), F.min_by("a", F.struct("distance", "a")).alias("a")).collect()}
    want = {}
    for (a, x), (b, y) in itertools.combinations(prints, 2):
        if (d := (x ^ y).bit_count()) <= 3:
            want[b] = min(want.get(b, (9, 0)), (d, a))
    assert got == want
