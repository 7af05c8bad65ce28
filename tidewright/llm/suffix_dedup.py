"""Exact-substring dedup by difference-cover suffix arrays.

A window of LENGTH bytes is anchored at the least hash of the GRAM-byte strings in it, so equal windows have equal
anchors at the same place. The windows of one anchor that follow one another make a unit of at most
2 * LENGTH - GRAM bytes. Texts lie in blocks. Each block sends its distinct anchors, as sorted arrays, to the buckets
of a shuffle; the buckets answer which anchors occur more than once. For these the blocks send their units to the
buckets. Equal units share their smallest doc_id; different units of one anchor are compared by a suffix array of
their bytes: triples at two of three places are sorted and named, names are recursed upon, the remaining suffixes
are merged in, and adjacent suffixes with equal prefixes share the smallest doc_id of any of them. The blocks get the answers and cut their texts. An anchor that occurs very often is left out of the
suffix arrays: its windows count as units of their own, which any number of buckets share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_table, discard, release, settle, slices, table, utf8
from .shingles import mix

#: Bytes of a repeated string, and of the strings that anchor it.
LENGTH, GRAM = 50, 20
#: Bytes that one suffix array is built of, and occurrences of an anchor whose units are still sorted together.
PIECE, CROWD = 1 << 18, 12_000
#: Bytes of text to a bucket: a task holds the anchors of one, so their number follows the input.
BUCKET = 64 << 20
#: Bytes of text in a block, unless its one text is longer, and windows that are anchored at a time.
BLOCK, SEGMENT = 2 << 20, 1 << 16
_B, _M = np.uint32(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(63)
#: A distinct unit of a block: anchor, key, least doc_id, number in the block, windows (0: one window of a crowded anchor),
#: the anchor's place in it, whether it is in several rows. An occurrence: the unit's number, bytes from the last start, windows.
HEAD = np.dtype([("h", "<u8"), ("key", "<u8"), ("doc", "<i8"), ("number", "<u4"), ("n", "u1"), ("place", "u1"), ("several", "u1")])
OWN = np.dtype([("number", "<u4"), ("step", "<u4"), ("n", "u1")])


def gram_keys(t: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A 32-bit hash of each k-byte string of t."""
    n = len(t) - k + 1
    power, have = {1: t.astype(np.uint32) + np.uint32(1)}, 1
    while have * 2 <= k:
        x = power[have]
        power[have * 2] = x[:-have] * np.uint32(pow(int(_B), have, 1 << 32)) + x[have:]
        have *= 2
    out, at = np.zeros(n, np.uint32), 0
    for size in sorted(power, reverse=True):
        if k - at >= size:
            out = out * np.uint32(pow(int(_B), size, 1 << 32)) + power[size][at : at + n]
            at += size
    for shift, factor in ((15, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out = (out ^ (out >> np.uint32(shift))) * np.uint32(factor)
    return out ^ (out >> np.uint32(16))


def string_hashes(t: np.ndarray, at: np.ndarray, size: np.ndarray | int, most: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the strings of t that start at `at` and have `size` bytes, 8 to `most`."""
    eight = np.lib.stride_tricks.sliding_window_view(t, 8)
    out = mix(np.full(len(at), seed, np.uint64) + np.asarray(size).astype(np.uint64) * _M)
    for k in range(0, most, 8):  # the last eight bytes again where no more are left
        word = np.ascontiguousarray(eight[at + np.minimum(k, size - 8)]).view(np.uint64).ravel()
        out = mix(out * _M + word)
    return out


def units_of(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and anchor's place of the units of texts that lie in t one after another."""
    got = []
    for base in range(0, len(t) - LENGTH + 1, SEGMENT):
        part = t[base : base + SEGMENT + LENGTH - 1]
        least = gram_keys(part).astype(np.uint64)
        least = least << np.uint64(32) | np.arange(len(least), dtype=np.uint64)
        span, width = 1, LENGTH - GRAM + 1
        while span * 2 <= width:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for e in ends[np.searchsorted(ends, base + 1) : np.searchsorted(ends, base + len(part))]:
            anchor[max(0, e - base - LENGTH + 1) : e - base] = -1  # windows over the end of a text
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        n, place = np.diff(np.append(first, len(anchor))), anchor[first]
        some = place >= 0
        got.append((first[some] + base, n[some], place[some] + base))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3


def _names(keys: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ranks of keys from 1, equal keys sharing one, and whether all differ."""
    order = np.argsort(keys, kind="stable")
    step = np.concatenate([[True], np.diff(keys[order]) != 0])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out, bool(step.all())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of s (values from 1, fewer than 2**20 of them) in order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    top = int(s.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, unique = _names((s[sample] * top + s[sample + 1]) * top + s[sample + 2])
    if not unique:
        inner = suffix_array(names)
        names = np.empty(len(sample), np.int64)
        names[inner] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    many = len(sample) + 2
    by_rank = np.empty(len(sample), np.int64)
    by_rank[names - 1] = sample
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    pair = lambda i: s[i] * many + rank[i + 1]
    triple = lambda i: (s[i] * top + s[i + 1]) * many + rank[i + 2]
    zero = zero[np.argsort(pair(zero), kind="stable")]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    at = np.arange(len(zero)) + np.searchsorted(pair(ones), pair(zero)) + np.searchsorted(triple(twos), triple(zero))
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at], out[~taken] = zero, by_rank
    return out


def earlier(texts: list[bytes], first: np.ndarray) -> list[np.ndarray]:
    """For each unit, windows whose string is also in a unit of smaller first; first is by unit."""
    size = np.array([len(t) for t in texts])
    s = np.frombuffer(b"\0".join(texts) + b"\0" * (LENGTH + 1), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    unit = np.repeat(np.arange(len(texts)), size - LENGTH + 1)
    valid = np.zeros(len(s), bool)
    place = np.arange(len(unit)) - np.repeat(np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1), size - LENGTH + 1) + begin[unit]
    valid[place] = True
    owner = np.zeros(len(s), np.int64)
    owner[place] = unit
    order = suffix_array(s[: len(s) - LENGTH].astype(np.int64) + 1)
    order = order[valid[order]]
    words = np.lib.stride_tricks.sliding_window_view(s, LENGTH)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        new[a:b] = (words[order[a:b]] != words[order[a - 1 : b - 1]]).any(axis=1)
    starts = np.nonzero(new)[0]
    least = np.minimum.reduceat(first[owner[order]], starts)
    hit = np.zeros(len(s), bool)
    hit[order] = least[np.cumsum(new) - 1] < first[owner[order]]
    return np.split(hit[place], np.cumsum(size - LENGTH + 1)[:-1])


def _pad(body: bytes) -> np.ndarray:
    return np.frombuffer(body + b"\0" * 8, np.uint8)


def blocks_of(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, sizes, body): texts (doc_id, text), compressed, about BLOCK bytes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK):
            texts = [t or b"" for t in utf8(batch.column("text"))]
            columns = [[number], [batch.column("doc_id").to_pylist()], [list(map(len, texts))], [pa.compress(b"".join(texts), "zstd", asbytes=True)]]
            number += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "doc_ids", "sizes", "body"])

    return docs.select("doc_id", "text").mapInArrow(run, "block long, doc_ids array<long>, sizes array<long>, body binary")


class Block:
    """The texts of a row of blocks_of(), those with a doc_id being compared."""

    def __init__(self, row: dict) -> None:
        self.ids, self.sizes = row["doc_ids"], np.array(row["sizes"], np.int64)
        self.body = pa.decompress(row["body"], int(self.sizes.sum()), "zstd", asbytes=True)
        self.ends = np.cumsum(self.sizes)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, numbers of windows, anchors' places, doc_ids and anchors' hashes (lowest bits 0) of all units."""
        self.t = _pad(self.body)
        start, n, place = units_of(self.t[:-8], self.ends)
        text = np.searchsorted(self.ends, start, side="right")
        known = np.array([d is not None for d in self.ids], bool)[text]
        start, n, place = start[known], n[known], place[known]
        ids = np.array([d or 0 for d in self.ids], np.int64)[text[known]]
        return start, n, place, ids, string_hashes(self.t, place, GRAM, GRAM, 1) & ~_LOW


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _packed(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for name, c in zip(kind.names, columns, strict=True):
        out[name] = c
    return out


def _columns(rows: np.ndarray) -> bytes:
    """The rows column by column, compressed, after their number."""
    return len(rows).to_bytes(8, "little") + pa.compress(b"".join(rows[c].tobytes() for c in rows.dtype.names), "zstd", asbytes=True)


def _restored(data: bytes, kind: np.dtype) -> np.ndarray:
    """The rows of _columns()."""
    n, at = int.from_bytes(data[:8], "little"), 0
    plain, out = pa.decompress(data[8:], n * kind.itemsize, "zstd", asbytes=True), np.empty(n, kind)
    for c in kind.names:
        out[c] = np.frombuffer(plain, kind[c], n, at)
        at += n * kind[c].itemsize
    return out


def _dealt(h: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Buckets and the places of the hashes that fall into them."""
    bucket = ((h >> np.uint64(6)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _by_bucket(rows: DataFrame, n: int, answer: Callable[[list[dict]], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """answer() for the rows (bucket, ...) of each bucket; buckets are numbers below n, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in chain(_rows(batches), [None]):
            if held and (r is None or r["bucket"] != held[0]["bucket"]):
                found = list(answer(held))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [()] * len(schema), schema, strict=True)], schema=schema)
                held = []
            held += [r] if r else []

    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, ddl)


def anchors(blocks: DataFrame, n: int) -> DataFrame:
    """(bucket, block, hashes): distinct anchors of each block, the lowest bits being the power of two that bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            h, count = np.unique(Block(r).units()[4], return_counts=True)
            h |= np.ceil(np.log2(count)).astype(np.uint64)
            dealt = _dealt(h, n)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in dealt], pa.int32()), pa.array([r["block"]] * len(dealt), pa.int64()), pa.array([h[p].tobytes() for _, p in dealt], pa.binary())], ["bucket", "block", "hashes"])

    return blocks.mapInArrow(run, "bucket int, block long, hashes binary")


def _shared(rows: list[dict], crowd: int) -> Iterator[tuple]:
    """(block, hashes) of anchors that occur more than once; the lowest bit marks those that occur more than `crowd` times."""
    own = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    every = np.concatenate(own)
    h, at = np.unique(every & ~_LOW, return_inverse=True)
    number = np.bincount(at, (1 << (every & _LOW).astype(np.int64)).astype(float), len(h))
    keep = (number > 1)[at]
    marked = (h | (number > crowd).astype(np.uint64))[at]
    ends = np.cumsum([len(x) for x in own])
    for r, a, k in zip(rows, np.split(marked, ends[:-1]), np.split(keep, ends[:-1]), strict=True):
        if k.any():
            yield r["block"], a[k].tobytes()


def units(blocks: DataFrame, n: int) -> DataFrame:
    """Units of blocks (block, doc_ids, sizes, body, shared) with a shared anchor: two kinds of rows.

    HEADs of distinct units, and their bytes without the anchors', compressed; or OWNs of all units, without bytes, in any bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            block = Block(r)
            start, size, place, ids, h = block.units()
            known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in r["shared"]]))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            found = (known[at] & ~_LOW) == h
            start, size, place, ids, h, crowd = (x[found] for x in (start, size, place, ids, h, (known[at] & np.uint64(1)) > 0))
            times = np.where(crowd, size, 1)  # a window of a crowded anchor stands alone
            begin = np.cumsum(times) - times
            each = np.repeat(np.arange(len(start)), times)
            start, place, ids, crowd = start[each] + np.arange(len(each)) - begin[each], place[each], ids[each], crowd[each]
            size, h = np.where(crowd, 1, size[each]), h[each]
            alone = np.flatnonzero(crowd)
            h[alone] = string_hashes(block.t, start[alone], LENGTH, LENGTH, 3) & ~_LOW
            key = string_hashes(block.t, start, size + LENGTH - 1, 2 * LENGTH - GRAM, 2)
            order = np.lexsort((ids, key, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])]) if len(h) else np.zeros(0, bool)
            number = np.empty(len(h), np.int64)
            number[order] = np.cumsum(new) - 1
            one = order[new]  # of each distinct unit, the place of the least doc_id
            last = order[np.append(new[1:], True)] if len(h) else one
            heads = _packed(HEAD, h[one], key[one], ids[one], np.arange(len(one)), np.where(crowd[one], 0, size[one]), place[one] - start[one], ids[last] > ids[one])
            rows = []
            for b, p in _dealt(h[one], n):
                some = p[heads["n"][p] > 0]
                ends = zip(start[one[some]].tolist(), place[one[some]].tolist(), heads["n"][some].tolist(), strict=True)
                body = b"".join(block.body[a:m] + block.body[m + GRAM : a + k + LENGTH - 1] for a, m, k in ends)
                rows.append((b, _columns(heads[p]), pa.compress(body, "zstd", asbytes=True)))
            rows.append((r["block"] % n, _columns(_packed(OWN, number, np.diff(start, prepend=0), size)), None))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([r["block"]] * len(rows), pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "block", "heads", "bodies"])

    return blocks.mapInArrow(run, "bucket int, block long, heads binary, bodies binary")


def _spread(start: np.ndarray, n: int) -> np.ndarray:
    return (start[:, None] + np.arange(n)).ravel()


def _halves_met(t: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a unit shares, with another of its anchor, the bytes at one side of it that half of its windows need."""
    half = (LENGTH - GRAM) // 2
    met = np.zeros(len(at), bool)
    for some, offset, n in ((place - size + 1 <= half, GRAM, half), (place > half, -half - 1, half + 1)):
        k = np.flatnonzero(some)
        _, inverse, count = np.unique(string_hashes(t, at[k] + place[k] + offset, n, n, 4) ^ h[k], return_inverse=True, return_counts=True)
        met[k] |= (count > 1)[inverse]
    return met


def _pieces(number: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Where to cut units, whose anchors have ascending numbers, so that an anchor's stay together and a piece has PIECE bytes at most, or one anchor."""
    last = np.flatnonzero(np.append(np.diff(number) != 0, True)) if len(number) else number
    upto, cuts, k = np.cumsum(size)[last], [0], 0
    while k < len(last):
        k = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PIECE, side="right")))
        cuts.append(int(last[k - 1]) + 1)
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _compared(rows: list[dict]) -> Iterator[tuple]:
    """(block, firsts, runs, own): of the block's units by number, the least doc_id of equal ones, and runs of windows that lie in a unit of smaller doc_id, for those that have that least doc_id. OWNs are passed on."""
    yield from ((r["block"], None, None, r["heads"]) for r in rows if r["bodies"] is None)
    rows = [r for r in rows if r["bodies"] is not None]
    if not rows:
        return
    heads = [_restored(r["heads"], HEAD) for r in rows]
    x = np.concatenate(heads)
    bytes_of = lambda n: np.where(n > 0, n.astype(np.int64) + LENGTH - 1, 0)
    size = bytes_of(x["n"])
    begin = np.cumsum(size) - size
    with_body = np.flatnonzero(size)
    t, anchor = np.zeros(int(size.sum()) + 8, np.uint8), np.zeros(int(size.sum()) + 8, bool)
    anchor[_spread(begin[with_body] + x["place"][with_body], GRAM)] = True
    t[anchor] = np.tile(x["h"][with_body].view(np.uint8).reshape(-1, 8), 3)[:, :GRAM].ravel()  # the anchor's hash stands for it
    t[:-8][~anchor[:-8]] = np.frombuffer(b"".join(pa.decompress(r["bodies"], int((bytes_of(y["n"]) - GRAM * (y["n"] > 0)).sum()), "zstd", asbytes=True) for r, y in zip(rows, heads, strict=True)), np.uint8)
    order = np.lexsort((x["doc"], x["key"], x["h"]))
    h, key = x["h"][order], x["key"][order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
    group = np.empty(len(x), np.int64)
    group[order] = np.cumsum(new) - 1
    one = order[new]
    first, times = x["doc"][one], np.bincount(group)
    number = np.cumsum(np.concatenate([[True], np.diff(x["h"][one]) != 0])) - 1  # of the anchor
    contested = np.flatnonzero((np.bincount(number) > 1)[number] & (size[one] > 0))
    k = one[contested]
    contested = contested[_halves_met(t, begin[k], x["n"][k].astype(np.int64), x["place"][k].astype(np.int64), x["h"][k])]
    runs: dict[int, list[list[int]]] = {}
    for a, b in _pieces(number[contested], size[one[contested]] + 1):
        g = contested[a:b]
        k = one[g]
        for u, hit in zip(g.tolist(), earlier([t[i : i + n].tobytes() for i, n in zip(begin[k].tolist(), size[k].tolist(), strict=True)], first[g]), strict=True):
            if hit.any():
                runs[u] = _runs(hit)
    tell = (times[group] > 1) | (x["several"] > 0)
    found = np.zeros(len(one), bool)
    found[list(runs)] = True
    ends = np.cumsum([len(y) for y in heads])
    for r, a, b in zip(rows, (ends - [len(y) for y in heads]).tolist(), ends.tolist(), strict=True):
        own = np.arange(a, b)
        firsts = own[tell[a:b]]
        own = own[found[group[a:b]] & (x["doc"][a:b] == first[group[a:b]])]
        hits = [(i, d, *run) for i, d, g in zip(x["number"][own].tolist(), x["doc"][own].tolist(), group[own].tolist(), strict=True) for run in runs[g]]
        if len(firsts) or hits:
            yield r["block"], np.column_stack([x["number"][firsts].astype(np.int64), first[group[firsts]]]).tobytes(), np.array(hits, np.int64).tobytes(), None


def _runs(hit: np.ndarray) -> list[list[int]]:
    """[start, length] of the runs of True."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return np.column_stack([a, b - a]).tolist()


def cut(blocks: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each text of blocks (block, doc_ids, sizes, body, own, answers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            block = Block(r)
            edge = np.zeros(len(block.body) + 1, np.int32)
            if r["answers"]:
                own = _restored(r["own"], OWN)
                number, start, size = (own[c].astype(np.int64) for c in OWN.names)
                start = np.cumsum(start)
                ids = np.array([d or 0 for d in block.ids], np.int64)[np.searchsorted(block.ends, start, side="right")]
                first = np.full(number.max(initial=0) + 1, np.iinfo(np.int64).max)
                told = np.concatenate([np.frombuffer(x["firsts"], np.int64) for x in r["answers"]]).reshape(-1, 2)
                first[told[:, 0]] = told[:, 1]
                gone = first[number] < ids
                spans = [(start[gone], size[gone])]
                runs = np.concatenate([np.frombuffer(x["runs"], np.int64) for x in r["answers"]]).reshape(-1, 4)
                order = np.argsort(number, kind="stable")  # the occurrences of each run's unit
                a, b = (np.searchsorted(number[order], runs[:, 0], side=side) for side in ("left", "right"))
                for of, low, high in zip(runs.tolist(), a.tolist(), b.tolist(), strict=True):
                    k = order[low:high]
                    k = k[ids[k] == of[1]]
                    spans.append((start[k] + of[2], np.full(len(k), of[3])))
                start, size = (np.concatenate(x) for x in zip(*spans, strict=True))
                np.add.at(edge, start, 1)
                np.subtract.at(edge, start + size + LENGTH - 1, 1)
            removed = np.cumsum(edge)[:-1] > 0
            t, out = np.frombuffer(block.body, np.uint8), []
            for a, b in zip((block.ends - block.sizes).tolist(), block.ends.tolist(), strict=True):
                gone = removed[a:b]
                n = int(np.count_nonzero(gone))
                kept = t[a:b][~gone] if n else t[a:b]
                out.append((b - a, n, int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] > gone[:-1])) if n else 0, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return blocks.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def buckets_for(docs: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, or more where a bucket would have over BUCKET bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def removed_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """What is left of documents (doc_id, text; other columns are ignored) without strings of LENGTH bytes that start in a document of smaller doc_id.

    Null and empty texts have no bytes. Rows of one doc_id are not compared with each other, and a row without
    doc_id with none: it stays whole. Repeated rows keep a row each. A text of any length is anchored a segment
    at a time, but is held whole by one task. No documents give no rows.
    """
    spark = docs.sparkSession
    n = buckets_for(docs)
    blocks = dealt_table(blocks_of(docs), "block", n, "repeat_blocks")
    release(spark)
    answer = pa.schema([("block", pa.int64()), ("hashes", pa.binary())])
    shared = settle(_by_bucket(anchors(blocks, n), n, partial(_shared, crowd=crowd), answer, "block long, hashes binary"), "repeat-shared")
    release(spark)
    known = shared.groupBy("block").agg(F.collect_list("hashes").alias("shared"))
    answer = pa.schema([("block", pa.int64()), ("firsts", pa.binary()), ("runs", pa.binary()), ("own", pa.binary())])
    told = _by_bucket(units(blocks.join(known, "block"), n), n, _compared, answer, "block long, firsts binary, runs binary, own binary")
    told = settle(told, "repeat-told")
    discard(shared)
    release(spark)
    answers = F.collect_list(F.when(F.col("firsts").isNotNull(), F.struct("firsts", "runs"))).alias("answers")
    return cut(blocks.join(told.groupBy("block").agg(answers, F.max("own").alias("own")), "block", "left"))


def op3_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings that start in an earlier one; see removed_repeats() for nulls and repeated rows."""
    return removed_repeats(table(spark, sf_dir, "documents"))
