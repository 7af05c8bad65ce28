"""Queries and operators against SQL or brute force on small inputs made for the findings of round 4."""

import itertools
import random

import pytest

from tests.test_round_three import both
from tidewright.operators import dedup, graphs


def _told(*parts) -> list[str]:
    """Texts of long words, each before a name."""
    return [" ".join(f"{w * 4} {n}" for w, n in zip(itertools.cycle(words), names, strict=False)) + " " + " ".join(w * 4 for w in words) + "." for words, names in parts]


#: The first of equal long words is unlike the others by its names, and those are alike; so are two with words of their own.
APART = _told((["ab", "cd", "ef"], ["Zzz", "Yyy"]), (["ab", "cd", "ef"], ["Aaa", "Bbb"]), (["ab", "cd", "ef"], ["Aaa", "Bbb", "Ccc"]), (["ab", "cd", "ef", "gh"], ["Aaa", "Bbb"]), (["ab", "cd", "ef", "gh"], ["Ddd", "Eee"]), (["ij"], ["Ddd", "Eee"]), (["ij"], ["Ddd", "Eee"]), (["kl"], []), (["kl"], []))


def test_f8_documents_alike_are_linked_whatever_the_first_copy_of_their_words_is_like(spark, tmp_path):
    got, want = both(spark, tmp_path, "insight_clusters", documents={"doc_id": [*range(len(APART))], "text": APART})
    assert got == want and [r[:2] for r in want] == [(1, 3), (5, 2)]


@pytest.mark.parametrize("crowd", [4, 4096])
def test_f8_links_join_what_all_pairs_join(spark, monkeypatch, crowd):
    monkeypatch.setattr(dedup, "CROWD_ROWS", crowd)
    rnd = random.Random(crowd)
    base = [(rnd.sample(range(9), rnd.randrange(1, 4)), rnd.sample(range(100), rnd.randrange(1, 40))) for _ in range(25)]
    sets = base + [(x[: max(1, len(x) - rnd.randrange(2))], y[rnd.randrange(1, 4) :] or y) for x, y in base * 4] + [([], [1]), ([1], []), (None, None)]
    alike = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    full = [k for k, s in enumerate(sets) if s[0] and s[1]]
    label = {k: k for k in full}
    for a, b in itertools.combinations(full, 2):
        if 0.5 * alike(sets[a][1], sets[b][1]) + 0.5 * alike(sets[a][0], sets[b][0]) >= 0.72 and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    links = dedup.linked_sets(spark.createDataFrame([(k, *s) for k, s in enumerate(sets)], "id int, y array<int>, x array<int>"), "id", "y", "x", 0.72)
    got = {r.id: r.component for r in graphs.components(links).collect()}
    assert {k: got.get(k, k) for k in full} == label and len(set(label.values())) < len(full) - 10


def test_f9_meta_signals_of_equal_names_are_all_compared(spark, tmp_path):
    # by confidence: three clusters of the names Aaa to Ddd, the first with counts unlike those of the other two, which are alike; one of equal counts
    some = lambda tag, *names: _told(*[([tag[0] + c for c in tag], n) for n in names])
    full, a, d = ["Aaa", "Bbb", "Ccc", "Ddd"], ["Aaa", "Bbb", "Ccc"], ["Bbb", "Ccc", "Ddd"]
    texts = [*some("abcd", full, *[a] * 6), *some("efgh", full, *[d] * 6), *some("ijkl", full, *[d] * 6), *some("mnop", full, *[["Ddd", "Bbb", "Ccc"]] * 5), *some("qrst", ["Eee", "Fff"], ["Eee", "Fff"])]
    got, want = both(spark, tmp_path, "merged_meta_signals", documents={"doc_id": [*range(len(texts))], "text": texts})
    assert got == want and len(want) >= 2


def test_f9_clusters_near_each_other_but_not_the_first_of_their_names(spark, tmp_path):
    some = lambda tag, *names: _told(*[([tag[0] + c for c in tag], n) for n in names])
    full = ["Aaa", "Bbb"]
    texts = [*some("abcd", full, full), *_told((["aa", "ab", "ac", "ad"], ["Aaa"])) * 8, *some("efgh", full, full), *_told((["ee", "ef", "eg", "eh"], ["Bbb"])) * 8, *some("ijkl", full, full), *_told((["ii", "ij", "ik", "il"], ["Bbb"])) * 8]
    got, want = both(spark, tmp_path, "merged_meta_signals", documents={"doc_id": [*range(len(texts))], "text": texts})
    assert got == want and sorted(r[1] for r in want) == [1, 2]


def test_f10_copies_of_a_vector_count_among_themselves_and_with_all_that_are_near(spark, tmp_path):
    import pyarrow as pa

    rnd = random.Random(6)
    base = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    vectors = base + base[:4] * 3 + [[2 * v for v in base[0]], [-v for v in base[1]]]
    labels = [rnd.randrange(4) if k % 7 else None for k in range(len(vectors))]
    got, want = both(spark, tmp_path, "reprint_ratios", embeddings={"vec_id": [*range(len(vectors))], "label": pa.array(labels, pa.int32()), "embedding": pa.array(vectors, pa.list_(pa.float64()))})
    assert got == want and max(r[1] for r in want) > 4


@pytest.mark.parametrize("many", [3, 400])
def test_f1_pieces_of_a_suffix_array_stay_small_where_anchors_have_many_units(many):
    import numpy as np

    from tidewright.llm import suffix_dedup

    rnd = np.random.default_rng(many)
    number = np.repeat(np.arange(60_000 // many), rnd.integers(1, 2 * many, 60_000 // many)) * 3
    size = rnd.integers(51, 82, len(number))
    cuts = suffix_dedup._pieces(number, size)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(number) and all(a[1] == b[0] for a, b in itertools.pairwise(cuts))
    assert all(size[a:b].sum() <= suffix_dedup.PIECE or len(set(number[a:b])) == 1 for a, b in cuts)
    assert all(number[b - 1] != number[b] for _, b in cuts[:-1]) and len(cuts) < 4 * size.sum() / suffix_dedup.PIECE
    assert suffix_dedup._pieces(number[:0], size[:0]) == []


@pytest.mark.parametrize("spread", [0.5, 0.8, 3.0])
def test_f4_thresholds_are_exact_and_copies_count(spark, tmp_path, spread):
    import pyarrow as pa

    rnd = random.Random(4)
    vectors, labels = [], []
    for label, size in ((1, 60), (2, 25), (3, 2), (4, 1)):  # a centre each: the quantile lies within the bounds for some spreads
        centre = [rnd.gauss(0, 1) for _ in range(8)]
        vectors += [[c + rnd.gauss(0, spread) for c in centre] for _ in range(size)]
        labels += [label] * size
    vectors, labels = vectors + vectors[:15] * 2 + vectors[70:75], labels + [1] * 15 + [2] * 20
    got, want = both(spark, tmp_path, "tuned_thresholds", embeddings={"vec_id": [*range(len(vectors))], "label": labels, "embedding": pa.array(vectors, pa.list_(pa.float64()))})
    assert got == want and len(got) >= 2


def test_f4_quantiles_need_no_pairs_and_do_not_depend_on_blocks(spark):
    rnd = random.Random(5)
    vectors = [[rnd.gauss(0.5, 1) for _ in range(6)] for _ in range(70)]
    df = spark.createDataFrame([(k % 2, v) for k, v in enumerate(vectors + vectors[:9])], "g int, v array<double>")
    one, many = ({r.g: (r.n, r.value) for r in graphs.near_quantiles(df, "g", "v", 0.1, 0.9, -1.0, 2.0, block).collect()} for block in (1000, 8))
    assert one.keys() == many.keys() == {0, 1}
    assert all(one[g][0] == many[g][0] and one[g][1] == pytest.approx(many[g][1], abs=1e-12) for g in one)


def test_f3_spreading_rounds_at_each_hop_as_the_sql_and_deals_its_edges_once(spark):
    import pathlib

    import duckdb

    from tidewright.plans import ORACLE_SQL, QUERIES
    from tidewright.sources.tables import shared_folder

    c = duckdb.connect()
    for name in ("lineitem", "supplier"):
        c.sql(f"create view {name} as select * from '/root/testdata/sf0.01/{name}.parquet'")
    want = {(o, h): (n, round(x, 6)) for o, h, n, x in c.sql(f"select origin, hop, nodes, impact from ({ORACLE_SQL['spreading']})").fetchall()}
    before = {str(p) for p in pathlib.Path(shared_folder(spark)).glob("edges_*")}
    df = QUERIES["spreading"](spark, "/root/testdata/sf0.01")
    assert {(r.origin, r.hop): (r.nodes, round(r.impact, 6)) for r in df.collect()} == want
    (new,) = {str(p) for p in pathlib.Path(shared_folder(spark)).glob("edges_*")} - before
    assert any("_0000" in p.name for p in pathlib.Path(new).glob("*.parquet"))  # files of buckets


@pytest.mark.parametrize("meeting", [8, 16_384])
def test_f2_sets_do_not_travel_along_pairs_and_crowded_items_are_dealt(spark, monkeypatch, meeting):
    monkeypatch.setattr(dedup, "MEETING", meeting)
    rnd = random.Random(7)
    base = [rnd.sample(range(400), rnd.choice((5, 40, 150, 300))) for _ in range(30)]
    sets = [[x for x in s if rnd.random() > 0.06] + [1000 + rnd.randrange(40)] for s in base * 5] + [[1], [1, 2], [1, 2, 3], [], None]
    df = spark.createDataFrame([(f"k{k:03}", s) for k, s in enumerate(sets)], "id string, s array<int>")
    pairs = dedup.jaccard_pairs(df, "id", "s", 0.6)
    plan = pairs._jdf.queryExecution().toString()
    assert "array_intersect" not in plan and "CoGroups" in plan
    got = {(r.a, r.b): (r.both, r.similarity) for r in pairs.collect()}
    own = {}
    for k, s in enumerate(sets):
        own.setdefault(frozenset(s or ()), f"k{k:03}")
    want = {}
    for (s, a), (t, b) in itertools.combinations(own.items(), 2):
        if s and t and 10 * len(s & t) >= 6 * len(s | t):
            want[a, b] = (len(s & t), len(s & t) / len(s | t))
    want |= {(own[frozenset(s)], f"k{k:03}"): (len(set(s)), 1.0) for k, s in enumerate(sets) if s and own[frozenset(s)] != f"k{k:03}"}
    assert got == want and len(got) > 100


@pytest.mark.parametrize("lookup", [0, 10**9])
def test_f2_common_items_are_counted_alike_in_both_ways(monkeypatch, lookup):
    import pyarrow as pa

    monkeypatch.setattr(dedup, "LOOKUP", lookup)
    monkeypatch.setattr(dedup, "LOOK", 50)
    monkeypatch.setattr(dedup, "CELLS", 200)
    rnd = random.Random(9)
    sets = [sorted(rnd.sample(range(-30, 30), rnd.randrange(1, 40))) for _ in range(20)]
    pairs = list(itertools.combinations(range(20), 2))
    members = pa.table({"id": pa.array(range(20), pa.int64()), "x": pa.array(sets, pa.list_(pa.int64()))})
    got = dedup._common(members, pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]})).to_pylist()
    assert [(r["both"], r["total"]) for r in got] == [(len({*sets[a]} & {*sets[b]}), len(sets[a]) + len(sets[b])) for a, b in pairs]
