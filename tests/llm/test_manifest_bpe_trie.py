"""Manifest, byte-level BPE and prefix trie against plain versions."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import bpe, manifest, prefix_trie
from tidewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The top of a ternary tree, and for each leaf its (left, right) siblings level by level."""
    paths, at, own = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(own) > 1:
        for k, path in enumerate(paths):
            i = at[k]
            run = own[i // 3 * 3 : i // 3 * 3 + 3]
            path.append((run[: i % 3], run[i % 3 + 1 :]))
        own = [sha("".join(own[i : i + 3])) for i in range(0, len(own), 3)]
        at = [i // 3 for i in at]
    return own[0], paths


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = sha("".join(map(put, (doc_id, source, lang, n_chars, text))))
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = text.replace("\n", "") if even and text is not None else text
        groups.setdefault("" if source is None else "s" + source, []).append((doc_id, leaf, sha("".join(map(put, (doc_id, source, lang, n_chars, other))))))
    names = sorted(groups, key=str.encode)
    own = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for g in names}
    trees = {g: plain_tree([r[1] for r in own[g]]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    out = []
    for g, over in zip(names, above, strict=True):
        for (doc_id, leaf, forged), path in zip(own[g], trees[g][1], strict=True):
            d = forged
            for left, right in path + over:
                d = sha("".join([*left, d, *right]))
            proof = sha("".join(x for left, right in path + over for x in left + right))
            out.append((doc_id, leaf, trees[g][0], root, proof, d, d == root))
    return sorted(out, key=str)


def manifest_rows() -> list[tuple]:
    r = random.Random(4)
    rows = [(k, "big", r.choice(["en", None]), 3, r.choice(["a\nb", "ab", "", None, "ünï\n"])) for k in range(300)]
    rows += [(r.randrange(-50, 50), s, "de", None, "x\ny" * r.randrange(3)) for s in ("a", "b", "é", "") for _ in range(r.randrange(1, 12))]
    return rows + [(7, "lone", "en", 1, "t\n"), (None, None, None, None, None), (5, None, "en", 2, "\n"), (5, None, "en", 2, "\n"), (None, "big", "en", 2, "q"), (9, "big", "en", 4, "long " * 50_000)]


@pytest.mark.parametrize("levels", [5, 2, 1])
def test_op11_matches_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rows = manifest_rows()
    wide = ["grp", "n", "i", "level", "seg", "digest", "forged", "root", "all", "name"]
    df = spark.createDataFrame([(*r, *["x"] * len(wide)) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"{c} string" for c in wide))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = manifest.manifest(df, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))).drop("seg").collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_op11_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "y")], [(k, "a", "en", 1, "x") for k in range(3)]):
        got = manifest.manifest(spark.createDataFrame(rows, schema))
        assert sorted(map(tuple, got.drop("seg", "verified", "folded_root").collect()), key=str) == [r[:5] for r in plain_manifest(rows)]
        assert all(r.verified and r.folded_root == r.root for r in got.collect())


def test_op11_a_changed_digest_does_not_fold_to_the_root(spark):
    got = manifest.manifest(spark.createDataFrame([(k, "a", "en", 1, "x") for k in range(40)], "doc_id long, source string, lang string, n_chars long, text string")).collect()
    for r in got:
        assert manifest.folded(bytes(r.seg), bytes.fromhex(r.leaf))[1].hex() == r.root
        bent = bytearray(r.seg)
        bent[-1] ^= 1
        assert manifest.folded(bytes(bent), bytes.fromhex(r.leaf))[1].hex() != r.root


# ---- op12


def random_texts(n: int) -> list[str]:
    r = random.Random(11)
    letters = ["a", "b", "the", "in", " ", "  ", "\n", "\t", "'s", "'re", "<|endoftext|>", "<|endof", "0", "42", "é", "漢字", "　", "_", "==", "ing", "\r\n", "🙂", "\x00", "ñ"]
    return ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, " " * 2000, "\n" * 999, "=" * 700, "", "<|endoftext|>"]


def test_op12_equals_the_library():
    own, library = bpe.ByteBpe.of(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    texts = random_texts(4000) + ["".join(chr(c) for c in range(k, k + 400) if not 0xD800 <= c < 0xE000) for k in range(0, 0x11000, 400)]
    for text, ids, want in zip(texts, own.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids
        assert own.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False) == text


def test_op12_memo_and_steps_do_not_change_ids(monkeypatch):
    texts = random_texts(300)
    want = [x.tolist() for x in bpe.ByteBpe(BYTE_BPE).encode_all(texts)]
    for name, value in (("PIECES", 3), ("MEMO_PIECES", 5), ("MEMO_PAIRS", 7), ("LONG_PIECE", 2), ("STEP_BYTES", 10)):
        monkeypatch.setattr(bpe, name, value)
        assert [x.tolist() for x in bpe.ByteBpe(BYTE_BPE).encode_all(texts)] == want


def test_op12_pairs_are_those_that_merges_leave_apart():
    own, library = bpe.ByteBpe.of(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    r, ids = random.Random(2), [k for k, b in enumerate(bpe.ByteBpe.of(BYTE_BPE).bytes_of) if b.isalpha() and b.isascii()]
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids)
        whole = (own.bytes_of[a] + own.bytes_of[b]).decode()
        assert own.pairs.fits(a, b) == (library.encode(whole, add_special_tokens=False).ids == [a, b])


def test_op12_time_is_linear():
    import time

    own = bpe.ByteBpe.of(BYTE_BPE)
    began = time.time()
    for piece in (b"a" * 400_000, b"ab" * 200_000, b"aaaaab" * 60_000):
        next(own.encode_pieces([piece]))
    assert time.time() - began < 20


def test_op12_edges(spark):
    rows = [(1, "same"), (1, "same"), (None, None), (2, ""), (3, "long word " * 100_000), (None, "x<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    library = Tokenizer.from_file(BYTE_BPE)
    got = bpe.digests(df, BYTE_BPE).collect()
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.decoded for r in bpe.coded(df, BYTE_BPE, ("n_tokens",)).where("doc_id = 1").collect()} == {"same"}
    assert bpe.digests(df.limit(0), BYTE_BPE).count() == 0
    broken = df.limit(1).select(F.lit(9).cast("long").alias("doc_id"), F.expr("cast(unhex('61ff62') as string)").alias("text"))
    assert bpe.coded(broken, BYTE_BPE).first().decoded == "a�b"


# ---- op13


def plain_trie(turns: list[tuple]) -> list[tuple]:
    put = lambda x: x or ""
    digest = lambda r, t: hashlib.sha256(f"{len(put(r).encode())}:{put(r)}{put(t)}".encode()).hexdigest()[:32]
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), put(role), put(text)))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))))
        for p, m in members.items()
    )


def many_turns(seed: int) -> list[tuple]:
    r = random.Random(seed)
    say = ["hi", "yes", "no", "ünï", None, "", "long " * 20]
    rows = [(c, k, r.choice(["user", "assistant", None]), r.choice(say)) for c in r.sample(range(-150, 700), 120) for k in range(r.randrange(1, 9))]
    for c in (0, 200, 300):
        rows += [(c, k, "user", "start") for k in range(7)]
    for c in range(401, 440):
        rows += [(c, k, "user", f"same {k}") for k in range(9)]
    rows += [(c, 0, "user", f"other {c}") for c in range(500, 530)]
    return rows + [(None, 1, "user", "x"), (3, None, "user", "null turn"), (3, None, "user", "null turn"), (3, 2, "b", "tie"), (3, 2, "a", "tie"), (800, 1, None, None)]


@pytest.mark.parametrize(("block", "seed"), [(4096, 1), (16, 2), (3, 3)])
def test_op13_matches_a_plain_trie(spark, monkeypatch, block, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = many_turns(seed)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, own string, pos int, len int")
    got = prefix_trie.prefix_nodes(df)
    assert tuple(got.columns) == prefix_trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == plain_trie(rows)


def test_op13_small_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_nodes(make([])).count() == 0
    assert prefix_trie.prefix_nodes(make([(None, 1, "a", "b")])).count() == 0
    turnless = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 6 > 0][:3]
    for rows in ([(100, 1, "a", "b")], [(c, 1, "a", "b") for c in turnless], [(turnless[0], 1, "a", "b")], [(turnless[0], 1, "a", "b"), (100, 3, "u", "long " * 100_000)]):
        assert sorted(map(tuple, prefix_trie.prefix_nodes(make(rows)).collect()), key=lambda r: r[:2]) == plain_trie(rows)


def test_first_below_and_minima():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        v, start, bound = r.integers(0, 9, n), r.integers(0, n + 1, 200), r.integers(0, 10, 200)
        want = [next((k for k in range(s, n) if v[k] < b), n) for s, b in zip(start, bound, strict=True)]
        assert prefix_trie.first_below(v, start, bound).tolist() == want


@pytest.mark.parametrize("name", ["op11_pointer_jumping", "op13_interval_trie"])
def test_sql_says_the_same(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLE_SQL[name]).df()[list(got.columns)]
    rows = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert [r.replace(".0", "") for r in rows(got)] == [r.replace(".0", "") for r in rows(want)]
