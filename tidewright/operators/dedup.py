"""Duplicates by exact key, fingerprint distance, set overlap and edit ratio."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import released, settled

try:
    from _md5 import md5  # CPython's own: for strings as short as these a call costs less than one into OpenSSL
except ImportError:
    from hashlib import md5

#: What a product of a size and a threshold may be off by.
SLACK = 1e-9


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the least by order; sums and minima combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("n_copies")).select(*keys, "r.*", "n_copies")


#: Words of fingerprints, as bytes of a text in lower case; shorter runs do not count.
WORD = re.compile(rb"[a-z0-9]{3,}")


def simhash(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, fingerprint): bit b is set where more than half of the hashes of a text's distinct windows of n words have it.

    Words are runs of a-z and 0-9 in lower case, of three letters at least; a text of fewer than n words is one window, one
    without words has no row, a null counts as one window without bits. A hash is the low 64 bits of the window's MD5. Texts are
    counted in the tasks that read them: no window becomes a row, and what is shuffled is one row of counts for each text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, votes = [], [], []
            for k, t in enumerate(batch.column("_t")):
                ws = WORD.findall(t.as_py() or b"")
                if ws:
                    grams = set(map(b" ".join, zip(*[ws[i:] for i in range(n)], strict=False))) or {b" ".join(ws)}
                    low = np.frombuffer(b"".join([md5(g).digest() for g in grams]), np.uint8).reshape(-1, 16)[:, 8:]
                elif t.is_valid:
                    continue
                else:
                    low = np.zeros((1, 8), np.uint8)
                at.append(k)
                sizes.append(len(low))
                votes.append(np.unpackbits(low, axis=1).sum(axis=0, dtype=np.int64)[::-1])
            if at:
                ends = pa.array(np.arange(len(at) + 1) * 64, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(votes)))], [key, "n", "votes"])

    own = df.select(key, F.lower(text).cast("binary").alias("_t")).mapInArrow(count, f"{key} {df.schema[key].dataType.simpleString()}, n bigint, votes array<bigint>")
    votes = own.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.col("votes")[b]).alias(f"b{b}") for b in range(64)])
    bit = lambda b: F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    return votes.select(key, reduce(Column.bitwiseOR, [bit(b) for b in range(64)]).alias("fingerprint"))


def near_fingerprints(df: DataFrame, key: str, most: int = 3, bands: int = 4) -> DataFrame:
    """Pairs (a, b, distance) within `most` bits. With more bands than `most`, one band of a pair is equal, so none is missed.

    Equal fingerprints count as one before pairs are made; every key then joins its fingerprint's pairs and its
    fingerprint's smallest key.
    """
    if bands <= most:
        raise ValueError("the number of bands must exceed the distance")
    width = 64 // bands
    groups = df.groupBy("fingerprint").agg(F.min(key).alias("rep"))
    each = groups.withColumn("band", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fingerprint", k * width).bitwiseAND(F.lit((1 << width) - 1)).alias("v")) for k in range(bands)])))
    other = each.select(F.col("band").alias("band2"), F.col("rep").alias("b"), F.col("fingerprint").alias("f2"))
    d = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("f2")))
    pairs = each.join(other, (F.col("band") == F.col("band2")) & (F.col("rep") < F.col("b"))).select(F.col("rep").alias("a"), "b", d.cast("int").alias("distance")).where(F.col("distance") <= most).distinct()
    same = df.join(groups, "fingerprint").where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(0).alias("distance"))
    return pairs.unionByName(same)



#: Rows of an item that linked_sets() compares in one group; more are dealt in parts, each pair of which is a group.
CROWD_ROWS = 4096
#: Pairs that are looked at together, and 64-bit words of the two signatures.
LOOK, WORDS = 1 << 18, (2, 16)


def linked_sets(df: DataFrame, key: str, small: str, large: str, least: float, group: str | None = None, first: str | None = None) -> DataFrame:
    """Links (a, b) that join all rows which a chain of pairs joins: pairs whose mean Jaccard similarity over both columns of sets is at least `least`, above 0.5.

    Both similarities are then at least 2 * least - 1, so pairs share one of the first items of `small` in an order that all
    rows have (of hashes). Rows meet there with both sets, 64-bit hashes of their items; signatures rule out most, the others
    are compared in full. What is left out are pairs that earlier ones have joined already, so the links grow as the rows do and
    not as the pairs. With `group` and `first`, only pairs count whose rows are both first, or of one group with one of them first.
    """
    floor = 2 * least - 1
    hashed = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.xxhash64(x))))
    marks = [F.col(group).alias("grp"), F.col(first).alias("first")] if group else [F.lit("").alias("grp"), F.lit(True).alias("first")]
    rows = settled(df.select(F.col(key).alias("id"), hashed(small).alias("y"), hashed(large).alias("x"), *marks).where((F.size("x") > 0) & (F.size("y") > 0)), "hashed-sets")
    short = F.slice("y", 1, (F.size("y") - F.ceil(F.size("y") * floor - SLACK) + 1).cast("int"))
    each = rows.withColumn("item", F.explode(short))
    parts = each.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item", F.ceil(F.col("n") / CROWD_ROWS).cast("int").alias("parts"))
    dealt = each.join(parts, "item").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("item", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "x", "y", "grp", "first")
    met = dealt.repartition("item", "p", "q").sortWithinPartitions("item", "p", "q", F.size("x"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("item", "p", "q")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at != (now := tuple(place[:, a].tolist())):
                    yield from _joined_rows(held, floor, least)
                    held, at = [], now
                held.append(batch.slice(a, b - a))
        yield from _joined_rows(held, floor, least)

    kind = df.schema[key].dataType.simpleString()
    return met.mapInArrow(link, f"a {kind}, b {kind}").distinct()


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where the lists end."""
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))


def _signs(values: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """A row of `words` 64-bit words for each set of hashes: a bit is set where an odd number of them fall on it."""
    bits, out = 64 * words, []
    for k in range(0, len(ends), 1024):
        own = ends[k : k + 1024]
        begin = ends[k - 1] if k else 0
        row = np.repeat(np.arange(len(own)), np.diff(own, prepend=begin))
        odd = np.bincount(row * bits + (values[begin : own[-1]] & (bits - 1)), minlength=len(own) * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(len(own), bits), axis=1).view(np.uint64))
    return np.concatenate(out)


def _joined_rows(held: list[pa.RecordBatch], floor: float, least: float) -> Iterator[pa.RecordBatch]:
    """Links between rows of one group, which come by the size of x; see linked_sets()."""
    t = pa.Table.from_batches(held).combine_chunks() if held else None
    if t is None or t.num_rows < 2:
        return
    (x, x_ends), (y, y_ends) = (_flat(t.column(c).chunk(0)) for c in ("x", "y"))
    n, m, own, first = np.diff(x_ends, prepend=0), np.diff(y_ends, prepend=0), t.column("own").to_numpy(), t.column("first").chunk(0).to_numpy(zero_copy_only=False)
    grp = t.column("grp").chunk(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    sets = lambda v, ends, k: v[ends[k - 1] if k else 0 : ends[k]]
    signs, sizes = (_signs(y, y_ends, WORDS[0]), _signs(x, x_ends, WORDS[1])), (m, n)
    crossed = t.column("p")[0].as_py() != t.column("q")[0].as_py()
    label, pairs = np.arange(t.num_rows), []
    low = np.searchsorted(n, np.ceil(n * floor - SLACK))  # shorter ones are too short
    upto = np.cumsum(np.arange(t.num_rows) - low)
    a = 0
    while a < t.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LOOK, side="right")))
        many = np.arange(a, b) - low[a:b]
        j = np.repeat(np.arange(a, b), many)
        i = np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + low[j]
        a = b
        ok = (label[i] != label[j]) & ((first[i] & first[j]) | ((grp[i] == grp[j]) & (first[i] | first[j])))
        ok &= (own[i] != own[j]) if crossed else True
        i, j = i[ok], j[ok]
        most = np.zeros(len(i))
        for sign, size in zip(signs, sizes, strict=True):  # sets differ in as many items as their signatures in bits, or more
            total, apart = size[i] + size[j], np.bitwise_count(sign[i] ^ sign[j]).sum(axis=1, dtype=np.int64)
            similar = (total - apart) / (total + apart)
            ok = similar >= floor - SLACK
            i, j, most = i[ok], j[ok], most[ok] + 0.5 * similar[ok]
        ok = most >= least - SLACK
        for k, l in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if label[k] == label[l]:
                continue
            score = 0.0
            for v, ends in ((x, x_ends), (y, y_ends)):
                left, right = sets(v, ends, k), sets(v, ends, l)
                both = len(np.intersect1d(left, right, assume_unique=True))
                score += 0.5 * (both / (len(left) + len(right) - both))
            if score >= least:
                pairs.append((k, l))
                label[label == label[l]] = label[k]
    if pairs:
        ids = t.column("id").chunk(0)
        ends = [ids.take(pa.array(c)).to_pylist() for c in zip(*pairs, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(map(min, *ends), ids.type), pa.array(map(max, *ends), ids.type)], ["a", "b"])


#: Bins of items by hash, a power of two; their counts, of one byte each, are all that the driver sees of the items.
ITEM_BINS, CHUNK = 1 << 23, 1 << 16
#: Rows of an item that meet in one group; of more, parts are dealt and each pair of parts is a group.
MEETING = 16_384
#: Cells of the matrix that counts common items of a group of sets, and its products that cost as much as one item looked up.
CELLS, LOOKUP = 1 << 25, 1000


def _rarities(sets: DataFrame, items: str) -> np.ndarray:
    """For each bin of hashes how many items fall into it: 0 to 16 as they are, more by eighths of a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ITEM_BINS, np.int32)
        for batch in batches:
            at, times = np.unique(batch.column(items).flatten().to_numpy(zero_copy_only=False) & (ITEM_BINS - 1), return_counts=True)
            n[at] += times.astype(np.int32)
        some = [k for k in range(0, ITEM_BINS, CHUNK) if n[k : k + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pa.compress(n[k : k + CHUNK].tobytes(), "zstd", asbytes=True) for k in some], pa.binary())], ["chunk", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(pa.decompress(x, 4 * CHUNK, "zstd", asbytes=True), np.int32).astype(np.int64) for x in t.column("n").to_pylist())
        n = np.where(n <= 16, n, 16 + np.ceil(8 * np.log2(np.maximum(n, 16) / 16))).astype(np.uint8)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    out = np.zeros(ITEM_BINS, np.uint8)
    for r in sets.select(items).mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary").collect():  # a byte for each bin, however many sets there are
        out[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.n, np.uint8)
    return out


def _prefixes(sets: DataFrame, least: float, rarity: np.ndarray) -> DataFrame:
    """Rows (item, p, q, own, id, n, pos, sig) of the items in the prefixes of sets (id, x), rarest first, that others may have too.

    sig has a bit set where an odd number of the set's items fall on it, 1.25 bits an item or more. An item of many sets goes to groups (p, q) of two parts of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                x, ends = _flat(batch.column("x"))
                n = np.diff(ends, prepend=0)
                row = np.repeat(np.arange(len(n)), n)
                rare = rarity[x & (ITEM_BINS - 1)]
                order = np.lexsort((x, rare, row))
                x, rare, pos = x[order], rare[order], np.arange(len(x)) - (ends - n)[row]
                keep = (pos < (n - np.ceil(n * least - SLACK) + 1)[row]) & (rare > 1)  # what is alone meets nothing, and takes up a place
                x, rare, pos, row = x[keep], rare[keep].astype(float), pos[keep], row[keep]
                parts = np.maximum(1, np.ceil(np.where(rare <= 16, rare, 16 * 2 ** ((rare - 16) / 8)) / MEETING)).astype(np.int64)
                each = np.repeat(np.arange(len(x)), parts)
                other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
                own = ((x * 31 + row + k) & 0x7FFFFFFF)[each] % parts[each]
                width, sig = _width(n), np.empty(len(n), object)
                for w in np.unique(width):
                    mine = np.flatnonzero(width == w)
                    flat, stops = _flat(batch.column("x").take(pa.array(mine)))
                    sig[mine] = [s.tobytes() for s in _signs(flat, stops, int(w))]
                row = row[each]
                columns = [x[each], np.minimum(own, other), np.maximum(own, other), own, n[row], pos[each]]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), batch.column("id").take(pa.array(row)), pa.array(sig, pa.binary()).take(pa.array(row))], ["item", "p", "q", "own", "n", "pos", "id", "sig"])

    return sets.mapInArrow(cut, f"item long, p int, q int, own int, n int, pos int, id {sets.schema['id'].dataType.simpleString()}, sig binary")


def _width(n: np.ndarray) -> np.ndarray:
    """64-bit words of the signature of a set of n items."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1) / 51)), 2, 32).astype(np.int64)


def _met(t: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows of _prefixes() that share a group and may reach `least`; rows come by group and size."""
    n, pos, own, p, q = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "own", "p", "q"))
    item, rows = t.column("item").to_numpy(), t.num_rows
    group = np.cumsum((np.diff(item, prepend=item[:1]) != 0) | (np.diff(p, prepend=p[:1]) != 0) | (np.diff(q, prepend=q[:1]) != 0))
    low = np.searchsorted(group << 32 | n, group << 32 | np.ceil(n * least - SLACK).astype(np.int64))
    width, sig = _width(n), t.column("sig").combine_chunks()
    place, signs = np.zeros(rows, np.int64), {}
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        place[mine] = np.arange(len(mine))
        signs[w] = np.frombuffer(b"".join(sig.take(pa.array(mine)).to_pylist()), np.uint64).reshape(-1, w)
    upto, a, ids = np.cumsum(np.arange(rows) - low), 0, t.column("id").combine_chunks()
    while a < rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LOOK, side="right")))
        many = np.arange(a, b) - low[a:b]
        j = np.repeat(np.arange(a, b), many)
        i = np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + low[j]
        a = b
        # the first common item leaves enough behind it in both
        ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= (n[i] + n[j]) * (least / (1 + least)) - SLACK
        ok &= (p[i] == q[i]) | (own[i] != own[j])
        i, j = i[ok], j[ok]
        found = np.zeros(len(i), bool)
        short, long = width[i], width[j]
        for v, w in {(v, w) for v in signs for w in signs if v <= w}:
            mine = np.flatnonzero((short == v) & (long == w))
            if len(mine):
                folded = np.bitwise_xor.reduce(signs[w][place[j[mine]]].reshape(len(mine), w // v, v), axis=1)
                apart = np.bitwise_count(signs[v][place[i[mine]]] ^ folded).sum(axis=1, dtype=np.int64)
                found[mine] = apart <= (n[i[mine]] + n[j[mine]]) * ((1 - least) / (1 + least)) + 1e-6
        if found.any():
            got = np.unique(np.stack([i[found], j[found]]), axis=1) if len(i) < 1 << 12 else np.stack([i[found], j[found]])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(got[0])), ids.take(pa.array(got[1]))], ["a", "b"])


def _common(members: pa.Table, pairs: pa.Table) -> pa.Table:
    """Pairs (a, b) of sets (id, x) of one group with `both`, how many items they share, and `total`, how many they have together."""
    members = members.combine_chunks()
    x, ends = _flat(members.column("x").chunk(0))
    n = np.diff(ends, prepend=0)
    i, j = (pc.index_in(pairs.column(c), members.column("id")).to_numpy().astype(np.int64) for c in ("a", "b"))
    both = np.zeros(len(i), np.int64)
    kinds, item = np.unique(x, return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    short, other = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    upto = np.cumsum(n[short])
    if len(n) ** 2 * len(kinds) < LOOKUP * upto[-1]:
        step = max(1, CELLS // len(n))
        for k in range(0, len(kinds), step):  # some items at a time
            some = (item >= k) & (item < k + step)
            has = np.zeros((len(n), min(step, len(kinds) - k)), np.float32)
            has[row[some], item[some] - k] = 1
            both += (has @ has.T)[i, j].astype(np.int64)
    else:  # items of the smaller set are looked up in the other one
        held, c = row * len(kinds) + item, 0
        while c < len(i):
            d = max(c + 1, int(np.searchsorted(upto, (upto[c - 1] if c else 0) + LOOK, side="right")))
            many = n[short[c:d]]
            pair = np.repeat(np.arange(c, d), many)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + (ends - n)[short[pair]]
            want = other[pair] * len(kinds) + item[at]
            found = held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want
            both[c:d] = np.bincount(pair[found] - c, minlength=d - c)
            c = d
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "both": both, "total": n[i] + n[j]})


def jaccard_pairs(df: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """Pairs (a, b, both, similarity) of sets at or above a Jaccard similarity, by prefix filtering.

    Items, as 64-bit hashes, are ordered by how rare they are; sets that reach the threshold share one of the first
    n - ceil(least * n) + 1. Equal sets count as one. Sets meet as signatures, one row for each item of a prefix that is
    not alone; sizes, places and signatures rule out most pairs there. Candidates are compared in full in groups around the
    least set that each is a candidate with, so that a set travels to a few groups and not along its pairs.
    """
    kind = df.schema[key].dataType.simpleString()
    hashed = df.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(F.transform(items, lambda x: F.xxhash64(x)))).alias("x")).where(F.size("x") > 0)
    digests = [F.size("x").alias("n"), F.xxhash64("x").alias("d1"), F.xxhash64(F.lit(1), F.reverse("x")).alias("d2")]
    marked = hashed.select("id", *digests)
    groups = settled(marked.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "set-groups")
    sets = settled(hashed.select("id", "x", *digests).join(groups.withColumnRenamed("rep", "id"), ["id", "n", "d1", "d2"], "left_semi").select("id", "x"), "sets")
    released(df.sparkSession)
    prefixes = _prefixes(sets, least, _rarities(sets, "x"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [tuple(batch.column(c)[k].as_py() for c in ("item", "p", "q")) for k in (0, batch.num_rows - 1)]
            if held and ends[0] != last:  # nothing held goes on
                yield from _met(pa.Table.from_batches(held), least)
                held = []
            held.append(batch)
            last = ends[1]
        if held:
            yield from _met(pa.Table.from_batches(held), least)

    near = prefixes.repartition("item", "p", "q").sortWithinPartitions("item", "p", "q", "n").mapInArrow(meet, f"a {kind}, b {kind}")
    cand = settled(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "candidates")
    released(df.sparkSession)
    ends = cand.unionByName(cand.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = ends.groupBy("a").agg(F.min(F.least("a", "b")).alias("g"))
    dealt = settled(cand.join(label, "a"), "dealt-candidates")
    members = dealt.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")
    both = members.groupBy("g").cogroup(dealt.withColumnRenamed("g", "h").groupBy("h")).applyInArrow(_common, f"a {kind}, b {kind}, both long, total long")
    pairs = both.select("a", "b", F.col("both").cast("int").alias("both"), (F.col("both") / (F.col("total") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= least)
    same = marked.join(groups, ["n", "d1", "d2"]).where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.col("n").alias("both"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(same)



def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        m = row & masks.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def edit_ratio(a: Column, b: Column, sort_words: bool = False) -> Column:
    """Similarity 0 to 1 by insertions and deletions (2 * common / total); words sorted first if asked. Null for a null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None:
                return None
            if sort_words:
                s, t = (" ".join(sorted(v.lower().split())) for v in (s, t))
            n = len(s) + len(t)
            return 2 * common_length(s, t) / n if n else 1.0

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def near_in_block(df: DataFrame, key: str, block: list[str], text: str, least: float, sort_words: bool = True) -> DataFrame:
    """Pairs (a, b, ratio) of one block whose texts have an edit ratio of at least `least`.

    Within a block texts meet only if their lengths allow the ratio (spans of log length). The JVM's edit
    distance, which is at most the insertions and deletions that the ratio counts, leaves few for the
    ratio itself; equal texts count as one.
    """
    t = F.array_join(F.array_sort(F.split(F.lower(text), r"\s+")), " ") if sort_words else F.col(text)
    own = df.select(key, *block, t.alias("t")).where("t is not null")
    groups = own.groupBy(*block, "t").agg(F.min(key).alias("rep")).withColumn("n", F.length("t"))
    step = F.log((2 - least) / F.lit(least))
    span = F.floor(F.log(F.col("n") + 1.0) / step).cast("int")
    l = groups.withColumn("s", F.explode(F.array(span, span + 1)))
    r = groups.select(*block, F.col("t").alias("t2"), F.col("rep").alias("b"), F.col("n").alias("n2")).withColumn("s", F.floor(F.log(F.col("n2") + 1.0) / step).cast("int"))
    r = r.withColumn("s", F.explode(F.array(F.col("s"), F.col("s") + 1)))
    both = l.join(r, [*block, "s"]).where((F.col("rep") < F.col("b")) & (2 * F.least("n", "n2") >= least * (F.col("n") + F.col("n2")))).select(F.col("rep").alias("a"), "b", "t", "t2").distinct()
    both = both.where(F.levenshtein("t", "t2") <= (1 - least) * (F.length("t") + F.length("t2")))
    pairs = both.withColumn("ratio", edit_ratio(F.col("t"), F.col("t2"))).where(F.col("ratio") >= least).select("a", "b", "ratio")
    same = own.join(groups.select(*block, "t", "rep"), [*block, "t"]).where(F.col(key) != F.col("rep")).select(F.col("rep").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("ratio"))
    return pairs.unionByName(same)


def near_in_time(df: DataFrame, key: str, block: list[str], at: str, text: str, days: int, least: float) -> DataFrame:
    """Pairs (a, b, similarity) of one block, b up to `days` after a, whose texts are alike by 1 - edits / longer length.

    Of rows at one time the smaller key is a. Times are cut into spans of `days`; a row meets its own span and
    the next, so a block of many rows is dealt over its spans. Rows without a text or a time pair with nothing.
    """
    span = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(days * 86_400_000_000)).cast("long")
    own = df.select(key, *block, at, text).where(F.col(at).isNotNull() & F.col(text).isNotNull())
    l = own.select(*block, F.col(key).alias("a"), F.col(at).alias("_at"), F.col(text).alias("_ta"), F.explode(F.array(span, span + 1)).alias("_s"))
    r = own.select(*block, F.col(key).alias("b"), F.col(at).alias("_bt"), F.col(text).alias("_tb"), span.alias("_s"))
    later = (F.col("_bt") > F.col("_at")) | ((F.col("_bt") == F.col("_at")) & (F.col("a") < F.col("b")))
    p = l.join(r, [*block, "_s"]).where(later & (F.col("_bt") <= F.col("_at") + F.expr(f"interval {days} days")))
    longer, shorter = F.greatest(F.length("_ta"), F.length("_tb")), F.least(F.length("_ta"), F.length("_tb"))
    p = p.where(shorter >= least * longer)
    alike = F.coalesce(F.try_divide(F.levenshtein("_ta", "_tb"), longer), F.lit(0.0))
    return p.select("a", "b", (1 - alike).alias("similarity")).where(F.col("similarity") >= least)


def merged(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """One row for each group: the best-scored row, the group's size, its keys' number and the sum of scores."""
    rest = [c for c in df.columns if c != group]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(score, F.lit(float("-inf"))), -F.col(key)))
    return df.groupBy(group).agg(best.alias("r"), F.count(F.lit(1)).alias("n_merged"), F.sum(score).alias("score_sum")).select(group, "r.*", "n_merged", "score_sum")


def merged_ways(df: DataFrame, group: str, key: str, score: str, at: str) -> DataFrame:
    """(group, strategy, key, score, n_merged): groups of two rows or more merged in four ways.

    `higher_score` and `smart` keep the best-scored row, `recent` the newest, `combined` the least key with the
    mean score. A null score or time loses to any other, ties go to the least key. Rows without a group are left out. All is one aggregate, combined before the shuffle, so no group is ever held.
    """
    lowest = F.lit(float("-inf"))
    row = F.struct(F.col(key).alias("key"), F.col(score).alias("score"))
    best = F.max_by(row, F.struct(F.coalesce(score, lowest), -F.col(key)))
    newest = F.max_by(row, F.struct(F.coalesce(F.col(at).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), -F.col(key)))
    n = F.count(F.lit(1)).alias("n_merged")
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(best.alias("best"), newest.alias("newest"), F.struct(F.min(key).alias("key"), F.avg(score).alias("score")).alias("mean"), n).where("n_merged > 1")
    ways = {"higher_score": "best", "recent": "newest", "combined": "mean", "smart": "best"}
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("strategy"), f"{c}.key", f"{c}.score") for w, c in ways.items()]))
    return g.select(group, each.alias("r"), "n_merged").select(group, "r.strategy", F.col("r.key").alias(key), F.col("r.score").alias(score), "n_merged")


def combined_rank(score: Column, age_days: Column, trend: Column) -> Column:
    return 0.4 * score + 0.4 * F.pow(F.lit(0.5), age_days / 7) + 0.2 * trend
