"""The dealt operators against brute force, round trips and held-out labels, with nulls, empty texts, ties and extra columns."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewright.llm import common, decontamination, html_text, mixing, near_dup, quality, sharding, suffix_dedup, tokens, toxicity, warc
from tidewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, _b int"


def corpus(spark, seed=1, n=60):
    """Random texts with exact and near copies, shared passages, nulls, empty texts and columns that clash with inner names."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120))) for _ in range(n)]
    shared = " ".join(rnd.choice(vocabulary) for _ in range(40))
    for k in range(0, n, 7):
        texts[k] += "\n" + shared + "\n" + texts[k][:30]
    for k in range(0, n, 5):
        w = texts[k].split(" ")
        w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + ["", None, " \t\n", "Ünïcode çhars " * 9, None]
    rows = [(i * 3, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2"]), len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_op1_counts_slots_and_groups(spark):
    rows, df = corpus(spark)
    got = sharding.shard_documents(df.unionByName(df.where("doc_id is null")), 7).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    at = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        assert (at[i].size, at[i].text_crc32) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    groups = {}
    for i, t, *_ in rows:
        if t is not None:
            groups.setdefault(t, set()).add(at[i].shard)
    assert all(len(g) == 1 for g in groups.values())


def test_op1_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "same" if i < 40 else f"t{i}") for i in range(100)], "doc_id long, text string")
    got = sharding.shard_documents(df, 10).collect()
    assert set(Counter(r.shard for r in got).values()) == {10}
    assert len({r.shard for r in got if r.doc_id < 40}) <= 6 and sharding.shard_documents(nothing(spark), 5).count() == 0


def test_op2_codes_round_trip():
    rnd = np.random.default_rng(4)
    codes = rnd.integers(0, 1 << rnd.integers(1, 32, 5000), dtype=np.uint64).astype(np.uint32)
    for n in (0, 1, 3, 4, 5, 5000):
        control, data = tokens.encode_ids(codes[:n])
        assert len(control) == -(-n // 4) and (tokens.decode_ids(control, data, n) == codes[:n]).all()


def test_op2_matches_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows, df = corpus(spark)
    odd = [(10_000, "It's İstanbul, don't! <|endoftext|> <|ENDOFTEXT|> ﬁ x́y 3d 日本語。a1"), (10_001, "A b\u0085c")]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    t, got, at = Tokenizer.from_file(path), by_id(tokens.tokenized(df, path, 1)), 0
    for i, x in sorted([(r[0], r[1]) for r in rows] + odd):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.tokenized(nothing(spark), path, 1).count() == 0


def test_op3_suffix_array_order():
    rnd = random.Random(7)
    for n in (1, 2, 3, 10, 200, 4000):
        for letters in (1, 2, 9):
            s = np.array([rnd.randrange(1, letters + 1) for _ in range(n)])
            order = suffix_dedup.suffix_array(s).tolist()
            assert order == sorted(range(n), key=lambda i: s[i:].tolist())


def test_op3_units_do_not_depend_on_segments(monkeypatch):
    rnd = np.random.default_rng(5)
    t, ends = rnd.integers(0, 3, 5000).astype(np.uint8), np.array([20, 69, 70, 70, 900, 4000, 5000])
    owner = np.searchsorted(ends, np.arange(5000), side="right")
    for segment in (1 << 16, 64, 1):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        at = {}
        for start, n, place in zip(*suffix_dedup.units_of(t, ends), strict=True):
            at |= {int(i): int(place) for i in range(start, start + n)}
        assert set(at) == {i for i in range(4951) if owner[i] == owner[i + 49]}
        assert all(i <= a <= i + 30 for i, a in at.items())
        keys = suffix_dedup.gram_keys(t)
        assert all(keys[a] == keys[i : i + 31].min() for i, a in at.items())


@pytest.mark.parametrize("crowd", [12_000, 3, 1])
def test_op3_matches_brute_force(spark, crowd):
    rows, df = corpus(spark, 3)
    got, seen = by_id(suffix_dedup.removed_repeats(df, crowd)), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen.get(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert suffix_dedup.removed_repeats(nothing(spark)).count() == 0


def test_op3_buckets_follow_the_bytes(spark, monkeypatch):
    _, df = corpus(spark, 3)
    few = suffix_dedup.buckets_for(df)
    want = sorted(suffix_dedup.removed_repeats(df).collect(), key=str)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 4_000)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) < suffix_dedup.buckets_for(df)
    assert sorted(suffix_dedup.removed_repeats(df).collect(), key=str) == want


def test_op4_finds_planted_items(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((3, 6, 9, 15, 21, 33, 48, 59, 90))] + [(90, None), (91, ""), (92, "...")]
    docs, want = [], set()
    for k, (i, t) in enumerate(items[:9]):
        filler = lambda: " ".join(word() for _ in range(rnd.randrange(0, 80)))
        docs.append((k, f"{filler()} {t.upper()}!! {filler()}"))
        want.add((k, i))
        w = t.split()
        if len(w) >= 48:
            w[len(w) // 2] = "changed"
            docs.append((100 + k, f"{filler()} {' '.join(w)} {filler()}"))
            want.add((100 + k, i))
    docs += [(200 + k, " ".join(word() for _ in range(300))) for k in range(20)] + [(300, None), (301, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chunk in (5000, 4):
        assert {(r.doc_id, r.item_id) for r in decontamination.leaks(d, b, chunk).collect()} == want
    assert decontamination.leaks(nothing(spark), b).count() == 0 and decontamination.leaks(d, b.limit(0)).count() == 0


def test_op4_every_print_in_the_radius_is_found():
    rnd = np.random.default_rng(1)
    index = decontamination.Index([(i, " ".join(f"w{x}" for x in rnd.integers(0, 40, 20))) for i in range(30)])
    h = np.array([decontamination.WordHashes()[f"w{x}"] for x in rnd.integers(0, 40, 400)], np.uint64)
    h = decontamination.mix(h)
    want = set()
    for (window, step), (own, offset, f, _) in index.classes.items():
        g = decontamination.fingerprints(h, window, step)
        for a, b in itertools.product(range(len(g)), range(len(f))):
            if int(g[a] ^ f[b]).bit_count() <= index.radius:
                want.add((int(own[b]), int(a * step - offset[b])))
    assert index.near([h, h[:0], h[:30], h])[::3] == [want, want]


def test_op4_finds_every_copy_at_the_threshold():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.choice((1, 2, 2, 3, 9, 11))))
    items = [[word() for _ in range(n)] for n in range(20, 76)]
    index = decontamination.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    docs = []
    for w in items:
        light = min(range(4, len(w) - 4), key=lambda p: (sum(map(len, w[p - 4 : p + 5])), p))  # the word whose change weighs least
        middle = len(w) // 2 + rnd.randrange(-2, 3)
        copies = [w[:p] + ["x"] + w[p + 1 :] for p in (light, middle)]
        for p in rnd.sample(range(1, len(w) - 1), 6):
            q = rnd.randrange(len(w))
            copies += [w[:p] + ["x"] + w[p:], w[:p] + w[p + 1 :], w[p:] + w[:p], copies[0][:q] + ["y"] + copies[0][q + 1 :]]
        docs += [[word() for _ in range(rnd.randrange(30))] + c + [word() for _ in range(rnd.randrange(30))] for c in copies]
    got = index.leaks([" ".join(w) for w in docs], decontamination.WordHashes())
    per, found = len(docs) // len(items), 0
    for k, w in enumerate(docs):
        i = k // per
        n = len(items[i])
        each = [decontamination.similarity(index.shingles[i], decontamination.weights(w[s : s + n])) for s in range(max(0, len(w) - n) + 1)]
        assert got[k].get(i) == ((max(each), each.index(max(each))) if max(each) >= decontamination.LEAST else None)
        found += i in got[k]
    assert found > 400


def test_op5_counts_match_brute_force(spark):
    rows, df = corpus(spark, 5)
    rows += [(9_000, "a b c d e f g h " * 6 + "\n\nx y\nx y\n *#<>", "en", "s1", 0, 1, 2)]
    df = df.unionByName(spark.createDataFrame(rows[-1:], SCHEMA))
    got = by_id(quality.outliers(df))
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert quality.outliers(nothing(spark)).count() == 0


def test_op5_estimates_match_numpy_and_resist_outliers(spark):
    rnd = np.random.default_rng(8)
    x = rnd.normal(0, [1, 0.1, 0.5, 0.3, 0.4], (600, 5)) @ np.array([[1, 0.05, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0.2, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1]])
    x[:90] += [0, 3, 6, 0, 5]
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    e = quality.determinant_estimates(df).first()
    lower = np.array([[e[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    mean = np.array([e[f"m{i}"] for i in range(5)])
    d2 = (np.linalg.solve(lower, (x - mean).T) ** 2).sum(axis=0)
    assert (d2[:90] > quality.CUT).all() and (d2[90:] > quality.CUT).mean() < 0.01
    floors = np.diag(np.square(list(quality.FLOORS.values())))
    half = np.argsort(d2)[:450]
    assert np.abs(mean - x[half].mean(axis=0)).max() < 0.08
    assert np.abs((lower @ lower.T - floors) / quality.CONSISTENCY - np.cov(x[half].T, bias=True)).max() < 0.15


def test_op6_template_and_malformed_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r.html[r.html.find("<article>") + 9 : r.html.rfind("</article>")]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
        want = "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())))
        assert html_text.main_text(r.html) == want
    page = """<body><div class="ad">buy<article><header><h1>T &lt; 3</h1><p>by X</p></header><p>A &amp; b&nbsp;c<br>d<br><br>e</p><ul><li><a href=x>one</a><li><a>two</a><li><a>three</a></ul>
      <p>1 < 2 and <a href="a>b">3</a></p><div class="share">share</div></article><div class=comments><article><p>hey</p></article></div><form>x</form><footer>y</footer>"""
    assert html_text.main_text(page) == "T < 3\nA & b c d\ne\n1 < 2 and 3"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<script>x"), (4, "u", "plain text")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.n_chars for r in got][:2] == [0, 0] and len(got) == 5


def test_op6_blocks_without_an_article_element():
    good = "The quick fox is in the house and it was not for the faint of heart, as they say in the old books that were read to us by the fire in the winter of that year when all of the snow fell on the town."
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><div><h2>Head</h2><p>{good}</p><p>Yes.</p><p>{good}</p></div><div>&copy; 2020</div>"
    assert html_text.main_text(page) == f"Head\n{good}\nYes.\n{good}"


def test_op7_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.toxic == 0], [r.score for r in rows if r.toxic == 1]
    auc = np.mean([np.mean(np.array(good) < b) + 0.5 * np.mean(np.array(good) == b) for b in bad])
    hits = [r for r in rows if r.predicted == 1]
    assert auc > 0.95 and np.mean([r.toxic for r in hits]) > 0.93 and np.mean([s >= 0.7 for s in bad]) > 0.85


@pytest.mark.parametrize("share", [0.4, 0.5, 0.7])
def test_op7_learns_at_any_share_of_toxic_labels(spark, share):
    rnd = random.Random(7)
    plain, bad = [f"w{k}" for k in range(300)], ["vexling", "grolt", "snarb", "plooth", "drezz"]
    rows = []
    for i in range(900):
        toxic = int(rnd.random() < share)
        rows.append((i, " ".join(rnd.choices(plain, k=40) + (rnd.choices(bad, k=3) if toxic else [])), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scored(docs.drop("toxic"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.9 and np.mean([r.predicted for r in got if not r.toxic]) < 0.05


def test_op7_edges(spark):
    rows, df = corpus(spark)
    labels = spark.createDataFrame([(r[0], 0) for r in rows[:30]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = by_id(toxicity.scored(df, labels))
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert toxicity.keep_clean(df, labels).count() == len(rows) and toxicity.scored(nothing(spark), labels).count() == 0


def test_op7_label_model_discounts_copies():
    rnd = np.random.default_rng(0)
    y = rnd.random(4000) < 0.3
    noisy = lambda hit, false: np.where(y, rnd.random(4000) < hit, rnd.random(4000) < false)
    one = noisy(0.7, 0.2)
    v = np.column_stack([one, one, one, noisy(0.8, 0.1), noisy(0.75, 0.15), noisy(0.9, 0.05)]).astype(float)
    post, rates, weight = toxicity.label_model(v)
    assert weight[0] < 0.5 and weight[3] > 0.8 and np.mean((post > 0.5) == y) > 0.88


def test_op8_matches_a_plain_fold(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        url = rnd.choice(["http://www.a.com/x/", "https://a.com/x?utm_source=q", "http://a.com/x#f", "http://b.org/?p=1&ref=z", None])
        status = rnd.choice([200, 304, 304, 404])
        headers = {k: v for k, v in (("etag", rnd.choice(["1", "2", None])), ("last-modified", rnd.choice(["d1", "d2", None])), ("set-cookie", "c"), ("date", str(i))) if v}
        rows.append((i, url, rnd.randrange(150), status, headers, f"b{i}" if status == 200 else None))
    key = {"http://www.a.com/x/": 1, "https://a.com/x?utm_source=q": 1, "http://a.com/x#f": 1, "http://b.org/?p=1&ref=z": 2, None: None}
    df = spark.createDataFrame(rows, "record_id long, url string, at long, status int, headers map<string,string>, body_id string")
    for span in (20_000, 10):
        got = {r.record_id: r for r in warc.resolve_revisits(df, span).collect()}
        assert set(got) == {r[0] for r in rows if r[3] == 304}
        for i, url, at, _, h, _ in (r for r in rows if r[3] == 304):
            before = [r for r in rows if r[3] == 200 and url and key[r[1]] == key[url] and r[2] < at]
            src = max(before, key=lambda r: (r[2], r[0]), default=None)
            want = "orphan"
            if src:
                want = "unproved"
                for k in ("last-modified", "etag"):
                    if k in h and k in src[4]:
                        want = "merged" if h[k] == src[4][k] else "changed"
            assert (got[i].source_id, got[i].outcome) == (src and src[0], want)
            if want == "merged":
                assert got[i].headers == src[4] | {k: v for k, v in h.items() if k != "set-cookie"} and got[i].body_id == src[5]
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_op9_margins_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = mixing.mixed(docs).cache()
    own = mix.groupBy("lang").agg({"n_tokens": "sum"}).collect()
    total = sum(r[1] for r in own)
    power = {r[0]: r[1] ** 0.8 for r in own}
    got = {r.value: r.expected for r in mixing.margin_report(mix).where("margin = 'lang'").collect()}
    for k, p in power.items():
        assert got[k] == pytest.approx(0.7 * total * p / sum(power.values()), rel=0.05)
    rows, df = corpus(spark)
    r = by_id(mixing.mixed(df))
    assert len(r) == len(rows) and all(0 <= x.probability <= 1 for x in r.values())
    assert all(r[i].sampled for i, t, *_ in rows if not (t or "").split()) and mixing.mixed(nothing(spark)).count() == 0


def _sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def test_op10_matches_brute_force(spark):
    rows, df = corpus(spark, 9)
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    for k in range(80):  # near copies of one text, some beyond the threshold, whose pairs all share bands
        w = base[:]
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(150)] = f"e{rnd.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w[: 150 - rnd.randrange(0, 12)]), "en", "s1", 0, 1, 2))
    df = spark.createDataFrame(rows, SCHEMA)
    sets, parent = _sets(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for r in near_dup.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert near_dup.near_duplicates(nothing(spark)).count() == 0


def test_op10_sketches_merge_and_estimate():
    rnd = np.random.default_rng(3)
    common_, a, b = (rnd.integers(0, 1 << 63, n, np.uint64) for n in (6000, 1000, 1000))
    x, y = np.concatenate([common_, a]), np.concatenate([common_, b])
    rx, ry = near_dup.registers(x), near_dup.registers(y)
    assert (near_dup.merge(rx, ry) == near_dup.registers(np.concatenate([x, y]))).all()
    assert near_dup.joint_estimate(rx[None], ry[None], np.array([7000.0]), np.array([7000.0]))[0] == pytest.approx(0.75, abs=0.16)


def test_components_and_ranking(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[k] == 100 for k in range(100, 160))
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_op2_matches_the_tokenizer_on_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in df.collect())
    got, at = by_id(tokens.tokenized(df, path, 1)), 0
    for (i, _), e in zip(rows, Tokenizer.from_file(path).encode_batch_fast([t for _, t in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6_rules_find_the_text_without_article_elements(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    whole, found, extra = 0, 0, 0
    for r in pages:
        want = Counter(html_text.main_text(r.html).split("\n"))
        got = Counter(html_text.main_text(re.sub(r"<(/?)article\b", r"<\1div", r.html)).split("\n"))
        whole += sum(len(k) * v for k, v in want.items())
        found += sum(len(k) * v for k, v in (want & got).items())
        extra += sum(len(k) * v for k, v in (got - want).items())
    assert found > 0.99 * whole and extra < 0.01 * whole


def test_op6_rules_drop_link_blocks_of_an_article():
    text = "The fox is in the house and it was not for the faint of heart, as they say in the old books that were read to us. " * 2
    page = f"<article><h1>Head</h1><p>{text}</p><p><a href=x>All of this long paragraph is nothing but a link to some other page of the site</a></p><p>See <a href=y>this</a> too.</p></article>"
    assert html_text.main_text(page) == f"Head\n{text.strip()}\nSee this too."


@pytest.mark.parametrize("page", ["<p>x</p>" * 100_000, "<a b " * 50_000, '<a b="' * 50_000, '<a ">" ' * 50_000 + "'", "<div>" * 50_000 + "</span>" * 50_000, "<h2>x</h2>" * 50_000, "<script>" + "</script" * 50_000])
def test_op6_time_is_linear(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 10


def test_repeated_rows_null_ids_long_texts_and_clashing_columns(spark):
    """Each operator over rows that repeat, lack doc_ids, are very long, or have columns named like inner ones."""
    long = " ".join(f"w{k * 7919 % 1_000_003}" for k in range(200_000))
    rows = [(1, "same text here and some more words"), (1, "same text here and some more words"), (None, "no id " * 30), (None, None), (2, ""), (3, long), (4, long + " end"), (5, long)]
    wide = ["lang", "source", "n_chars", "rank", "block", "grp", "shard", "score", "kept", "band", "at", "w", "n"]
    df = spark.createDataFrame([(*r, *["x"] * len(wide)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in wide))
    ids = sorted((r[0] for r in rows), key=str)
    same = lambda got: sorted((r.doc_id for r in got), key=str) == ids
    assert same(sharding.shard_documents(df, 3).collect())
    import public_tokenizers

    assert same(tokens.tokenized(df, public_tokenizers.path("word_bpe_49k.json"), 1).collect())
    got = suffix_dedup.removed_repeats(df).collect()
    assert same(got) and {r.doc_id: r.n_removed for r in got} == {1: 0, None: 0, 2: 0, 3: 0, 4: len(long), 5: len(long)}
    items = spark.createDataFrame([(7, long[:300], "y")], "item_id long, text string, doc_id string")
    assert {r.doc_id for r in decontamination.leaks(df, items).collect()} == {3, 4, 5}
    assert same(quality.outliers(df).collect()) and same(mixing.mixed(df).collect())
    assert same(toxicity.scored(df, spark.createDataFrame([(1, 0, 0.5), (3, 1, 0.5)], "doc_id long, toxic int, score double")).collect())
    near = near_dup.near_duplicates(df).collect()
    assert same(near) and {r.doc_id: r.component_id for r in near} == {1: 1, None: None, 2: 2, 3: 3, 4: 3, 5: 3}
    pages = spark.createDataFrame([(1, "u", "<p>" + long, "z"), (1, "u", "<p>" + long, "z"), (None, None, "<p>a", "z")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extracted(pages).collect())[1:] == [len(long)] * 2
