"""Benchmark decontamination: SimHash fingerprints of item-sized windows.

Items fall into classes; each class has a window of W words, W being as large as any copy of the item that reaches
the threshold must hold unchanged in one piece (see piece_of()). All windows of an item are fingerprinted, and every
(W / 4)-th window of a document, so that such a piece holds a window that starts where one of the document's does.
Fingerprints are cut into RADIUS + 1 blocks: two that differ in RADIUS bits at most agree in one block, so looking up
all blocks finds every pair within the radius. Candidates are verified exactly, by the weighted similarity of
five-word shingles between the item and all windows of its own size that can hold the place.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8
from .shingles import WordHashes, mix

#: Largest number of differing bits, and words of a shingle.
RADIUS, SHINGLE = 3, 5
#: Weighted similarity from which a document holds an item.
LEAST = 0.75
#: Windows in words: below 256, for their votes are counted in bytes.
LADDER = [w for k in range(2, 8) for w in (1 << k, 3 << (k - 1))]
#: Items that one scan of the documents looks for.
ITEMS_A_SCAN = 5_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower())


def piece_of(words: list[str]) -> int:
    """Words that every window of the item's length at a weighted similarity of LEAST holds in one piece of the item.

    Of n words with n - 4 shingles, `lost` weigh most when the lightest go first, and a shingle that the item lacks
    weighs SHINGLE letters at least. Two pieces that do not follow each other in the item can share words only
    where the item repeats them: with `q` words repeated at most, 4 - q shingles between them are new. The new are
    no more than the lost, for the window is no longer than the item.
    """
    n = len(words)
    if n <= SHINGLE:
        return n
    q = next((q for q in range(SHINGLE - 1, 0, -1) if len({tuple(words[j : j + q]) for j in range(n - q + 1)}) < n - q + 1), 0)
    each = SHINGLE - 1 - q
    if not each:
        return SHINGLE
    letters = np.array([sum(map(len, words[j : j + SHINGLE])) for j in range(n - SHINGLE + 1)])
    lightest = np.cumsum(np.sort(letters))
    piece = n
    for breaks in range(n):
        lost = int(np.searchsorted(lightest, (1 - LEAST) * letters.sum() - LEAST * SHINGLE * each * breaks + 1e-6, side="right"))
        if lost < each * breaks:
            break
        piece = min(piece, -(-(len(letters) - lost) // (breaks + 1)) + SHINGLE - 1)
    return piece


def window_of(piece: int) -> tuple[int, int]:
    """Window and step for items whose copies hold `piece` words in one: W + step - 1 of them hold a window that starts at a multiple of step."""
    fit = [w for w in LADDER if w + w // 4 - 1 <= piece]
    return (fit[-1], fit[-1] // 4) if piece > SHINGLE else (max(1, piece), 1)


def fingerprints(h: np.ndarray, window: int, step: int, sums: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the windows that start at multiples of step: each word's hash votes on 64 bits."""
    if len(h) < window:
        return np.zeros(0, np.uint64)
    sums = running(h) if sums is None else sums
    votes = (sums[window:] - sums[:-window])[::step]
    return np.packbits(votes.view(np.uint8) > window // 2, axis=1).view(np.uint64).ravel()


def running(h: np.ndarray) -> np.ndarray:
    """Running sums of the words' bits, a byte for each, eight to a 64-bit number; differences over fewer than 256 words are exact."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    return np.concatenate([np.zeros((1, 8), np.uint64), np.cumsum(bits, axis=0, dtype=np.uint64)])


def weights(words: list[str]) -> Counter:
    """Shingles with their weights: the letters of the words, times the occurrences."""
    k = min(SHINGLE, len(words))
    out: Counter = Counter()
    for j in range(len(words) - k + 1):
        s = tuple(words[j : j + k])
        out[s] += sum(map(len, s))
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    both = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


class Index:
    """Fingerprints of a chunk of items, looked up by blocks."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS) -> None:
        self.items = {i: words_of(t or "") for i, t in items}
        self.shingles = {i: weights(w) for i, w in self.items.items()}
        self.radius, hashes = radius, WordHashes()
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        by_class = defaultdict(list)
        for i, w in self.items.items():
            if w:
                by_class[window_of(piece_of(w))].append(i)
        self.window = {i: window for (window, _), ids in by_class.items() for i in ids}
        self.classes = {}
        for (window, step), ids in by_class.items():
            prints = [fingerprints(mix(hashes.of(self.items[i])), window, 1) for i in ids]
            own = np.repeat(np.array(ids, np.int64), [len(p) for p in prints])
            offset = np.concatenate([np.arange(len(p)) for p in prints])
            f = np.concatenate(prints)
            tables = []
            for low, mask in self.blocks:
                key = (f >> low) & mask
                order = np.argsort(key, kind="stable")
                tables.append((order, np.searchsorted(key[order], np.arange(int(mask) + 2, dtype=np.uint64))))
            self.classes[window, step] = own, offset, f, tables

    def near(self, texts: list[np.ndarray]) -> list[set[tuple[int, int]]]:
        """For each text's word hashes, (item, word at which the item would start) of all fingerprints within the radius."""
        found: list[set[tuple[int, int]]] = [set() for _ in texts]
        sums = [running(h) for h in texts]
        for (window, step), (own, offset, f, tables) in self.classes.items():
            each = [fingerprints(h, window, step, s) for h, s in zip(texts, sums, strict=True)]
            size = np.array([len(x) for x in each])
            g, begin = np.concatenate(each), np.cumsum(size) - size
            for (low, mask), (order, starts) in zip(self.blocks, tables, strict=True):
                key = ((g >> low) & mask).astype(np.int64)
                first = starts[key]
                n = starts[key + 1] - first
                some = np.nonzero(n)[0]
                n, first = n[some], first[some]
                at = np.repeat(some, n)
                ends = np.cumsum(n)
                probe = order[np.repeat(first - ends + n, n) + np.arange(len(at))]
                hit = np.bitwise_count(g[at] ^ f[probe]) <= self.radius
                at, probe = at[hit], probe[hit]
                text = np.searchsorted(begin, at, side="right") - 1
                for k, i, start in zip(text.tolist(), own[probe].tolist(), ((at - begin[text]) * step - offset[probe]).tolist(), strict=True):
                    found[k].add((i, start))
        return found

    def leaks(self, texts: list[str], hashes: WordHashes) -> list[dict[int, tuple[float, int]]]:
        """Items that each text holds, with their best similarities and the words at which they start."""
        words = [words_of(t) for t in texts]
        near = self.near([mix(hashes.of(w)) for w in words])
        return [self.verified(w, c) for w, c in zip(words, near, strict=True)]

    def verified(self, words: list[str], near: set[tuple[int, int]]) -> dict[int, tuple[float, int]]:
        """Items with their best similarity over all windows that can hold a place in `near`, and the first word of the first such window."""
        out: dict[int, tuple[float, int]] = {}
        upto: dict[int, int] = {}
        for item, start in sorted(near):
            n, last = len(self.items[item]), max(0, len(words) - len(self.items[item]))
            reach = n - self.window[item]
            first, end = max(0, start - reach, upto.get(item, 0)), min(last, start + reach) + 1
            if first < end:
                upto[item] = end
                got, s = self.best(item, words, first, end)
                if got >= LEAST and got > out.get(item, (0.0, 0))[0]:
                    out[item] = got, s
        return out

    def best(self, item: int, words: list[str], first: int, end: int) -> tuple[float, int]:
        """The highest weighted similarity of the item and windows of its length that start at first, ..., end - 1, and the first start that has it."""
        n, own = len(self.items[item]), self.shingles[item]
        size, k = sum(own.values()), min(SHINGLE, n)
        words = words[first : end - 1 + n]
        count = min(n, len(words)) - k + 1
        here = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)]
        held: Counter = Counter()
        total = both = 0
        top = (0.0, first)
        for j, s in enumerate(here):
            w = sum(map(len, s))
            total += w
            if s in own:
                held[s] += w
                both += w if held[s] <= own[s] else 0
            if j >= count:
                s = here[j - count]
                w = sum(map(len, s))
                total -= w
                if s in own:
                    both -= w if held[s] <= own[s] else 0
                    held[s] -= w
            if j >= count - 1 and both and (got := both / (size + total - both)) > top[0]:
                top = got, first + j - count + 1
        return top


def leaks(docs: DataFrame, benchmark: DataFrame, items_a_scan: int = ITEMS_A_SCAN) -> DataFrame:
    """(doc_id, item_id, similarity, start_word) for documents (doc_id, text) that hold benchmark items (item_id, text).

    Items are taken in chunks of `items_a_scan`, each sent to the tasks that scan all documents; so what is sent
    is bounded. Null, empty and wordless texts and items match nothing; items of equal item_id count as their
    first text. A document of a doc_id on several rows is searched on each. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    n = items.count()
    chunks = max(1, -(-n // items_a_scan))
    out = None
    for c in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c) if chunks > 1 else items
        chunk = spark.sparkContext.broadcast(sorted(map(tuple, part.collect())))

        def run(batches: Iterator[pa.RecordBatch], chunk=chunk) -> Iterator[pa.RecordBatch]:
            index, hashes = Index(chunk.value), WordHashes()
            for batch in slices(batches, "text", 1 << 20):
                texts = [(t or b"").decode() for t in utf8(batch.column("text"))]
                rows = [(d, i, round(s, 6), at) for d, got in zip(batch.column("doc_id").to_pylist(), index.leaks(texts, hashes), strict=True) for i, (s, at) in got.items()]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "start_word"])

        got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long")
        out = got if out is None else out.unionByName(got)
    return out


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that all documents hold; see leaks() for nulls and repeated rows."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
