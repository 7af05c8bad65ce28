"""Toxicity by weak supervision.

Words and word beginnings that labelled texts tie to toxicity become voters, beside voters on how many and how
dense they are; the given label votes too. A generative model estimates each voter's accuracy and, from what is
left over, the correlations among voters, by which their votes are discounted. A linear classifier is trained on
the posterior labels and scores every text. It is fitted on a sample of at most TRAIN_ROWS labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

#: Labelled rows that the model is fitted on at most, by a hash of doc_id.
TRAIN_ROWS = 12_000
#: Entries of the lexicon at most, labelled texts that each needs, and lengths of word beginnings.
ENTRIES, SUPPORT, STEMS = 400, 5, range(3, 9)
#: The lower bound of an entry's odds of toxic texts must exceed this many times the overall odds.
LIFT = 2.0
#: Voters among the entries (the strongest), score from which a text is toxic.
VOTERS, TOXIC = 60, 0.7
MEMO_WORDS = 500_000


def entries_of(word: str) -> list[str]:
    """The word without punctuation, and its beginnings (marked by a final *)."""
    w = re.sub(r"[\W_]+", "", word)
    return [w, *(w[:k] + "*" for k in STEMS if len(w) > k)] if w else []


def training_rows(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most `most` rows that may be learnt from."""
    own = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def lexicon(train: DataFrame) -> list[str]:
    """Entries of texts (text, toxic) that mark toxicity, the strongest first; counts are summed on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in slices(batches, "text"):
            for text, toxic in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                words = set((text or b"").decode().lower().split())
                seen[toxic].update({e for w in words for e in entries_of(w)})
        keys = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in seen]], ["entry", "clean", "toxic"])

    n = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    counts = train.select("text", "toxic").mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p, m = F.col("t") / (F.col("c") + F.col("t")), F.col("c") + F.col("t")
    low = (p + 2 / m - 2 * F.sqrt(p * (1 - p) / m + 1 / (m * m))) / (1 + 4 / m)  # Wilson's bound for z = 2
    best = counts.where(F.col("t") >= SUPPORT).withColumn("low", low).where(F.col("low") * (1 - share) > LIFT * share * (1 - F.col("low"))).orderBy(F.desc("low"), F.desc("t"), "entry").limit(ENTRIES)
    return [r.entry for r in best.collect()]


class Hits(dict):
    """Word to the numbers of its entries."""

    def __init__(self, entries: list[str]) -> None:
        self.number = {e: k for k, e in enumerate(entries)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MEMO_WORDS:
            self.clear()
        got = self[word] = tuple(self.number[e] for e in entries_of(word) if e in self.number)
        return got

    def count(self, text: bytes | None) -> tuple[Counter, int, int]:
        """Texts' entries with counts, words with any entry, words."""
        words = (text or b"").decode().lower().split()
        hit = [e for w in words if (e := self[w])]
        return Counter(k for e in hit for k in e), len(hit), len(words)


def features(found: list[tuple[Counter, int, int]], n_entries: int) -> np.ndarray:
    """One row a text: ln(1 + count) of each entry, then of distinct entries and of hits, hits among words, 1."""
    x = np.zeros((len(found), n_entries + 4), np.float32)
    for i, (counts, hits, words) in enumerate(found):
        for k, c in counts.items():
            x[i, k] = np.log1p(c)
        x[i, n_entries:] = np.log1p(len(counts)), np.log1p(hits), min(1.0, 10 * hits / max(words, 1)), 1
    return x


def votes(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Votes of all voters: the strongest entries, five on number and density of entries, and the given label."""
    n = x.shape[1] - 4
    distinct, hits, rate = x[:, n], x[:, n + 1], x[:, n + 2]
    rules = [hits > 0, distinct > np.log(3.5), hits > np.log(2.5), rate > 0.1, rate > 0.3]
    return np.column_stack([x[:, : min(n, VOTERS)] > 0, *rules, label > 0]).astype(np.float64)


def label_model(v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of votes, by expectation maximisation from the last voter's labels.

    Also returned: the voters' rates of voting 1 given each label, and the weights their votes count with. A
    weight is one over one plus the sum of squared correlations with others that the label does not explain.
    """
    post = np.where(v[:, -1] > 0, 0.9, 0.05)
    weight = np.ones(v.shape[1])
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        one = np.clip((post @ v + 1) / (post.sum() + 2), 1e-3, 1 - 1e-3)
        zero = np.clip(((1 - post) @ v + 1) / ((1 - post).sum() + 2), 1e-3, 1 - 1e-3)
        left = v - (post[:, None] * one + (1 - post)[:, None] * zero)
        scale = np.sqrt((left**2).mean(axis=0)) + 1e-6
        corr = (left.T @ left) / len(v) / np.outer(scale, scale)
        weight = 1 / (1 + (corr**2).sum(axis=1) - np.diag(corr) ** 2)
        odds = np.log(prior / (1 - prior)) + v @ (weight * np.log(one / zero)) + (1 - v) @ (weight * np.log((1 - one) / (1 - zero)))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, np.array([zero, one]), weight


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by accelerated gradient descent; the last feature is the constant."""
    x = x.astype(np.float64)
    scale = np.sqrt((x**2).mean(axis=0)) + 1e-3
    z = x / scale
    w, m = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge / len(z))
    penalty[-1] = 0
    step = rate * 4 / np.linalg.norm(z, 2) ** 2 * len(z)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - m)
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        w, m = ahead - step * (z.T @ (p - y) / len(z) + penalty * ahead), w
    return w / scale


class Model:
    """A fitted classifier: entries and weights."""

    def __init__(self, entries: list[str], weights: np.ndarray) -> None:
        self.entries, self.weights = entries, weights

    def score(self, texts: list[bytes | None], hits: Hits | None = None) -> np.ndarray:
        hits = Hits(self.entries) if hits is None else hits
        z = features([hits.count(t) for t in texts], len(self.entries)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """The classifier from documents (doc_id, text) and labels (doc_id, toxic). Without usable labels every score is 0.

    The sample of labels, its texts' entry counts and the lexicon are bounded by `most` and ENTRIES.
    """
    sample = training_rows(labels, most)
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.least(F.greatest("toxic", F.lit(0)), F.lit(1)).cast("int").alias("toxic"))
    entries = lexicon(train)
    if not entries:
        return Model([], np.array([0.0, 0.0, 0.0, -30.0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(entries)
        for batch in slices(batches, "text"):
            found = [hits.count(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c, _, _ in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _, _ in found], pa.list_(pa.int32())), pa.array([h for _, h, _ in found], pa.int64()), pa.array([w for _, _, w in found], pa.int64()), batch.column("toxic")], ["k", "c", "hits", "words", "toxic"])

    got = train.mapInArrow(count, "k array<int>, c array<int>, hits long, words long, toxic int").collect()
    got.sort(key=lambda r: (r.words, r.hits, r.toxic, r.k))
    x = features([(dict(zip(r.k, r.c, strict=True)), r.hits, r.words) for r in got], len(entries))
    post, _, _ = label_model(votes(x, np.array([r.toxic for r in got])))
    return Model(entries, linear(x, post))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for documents (doc_id, text; other columns are ignored).

    Null, empty and wordless texts get the score of a text without entries. held_out of a null doc_id is that
    of an empty string. Repeated rows are scored each. Languages and sources are not looked at.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(model.entries)
        for batch in slices(batches, "text"):
            s = model.score(utf8(batch.column("text")), hits)
            ids = batch.column("doc_id")
            held = [zlib.crc32(str(d).encode() if d is not None else b"") % 3 == 1 for d in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(s, pa.float64()), pa.array((s >= TOXIC).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those rows of docs (doc_id, text and any others) that the classifier does not find toxic, in one pass over the texts."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(model.entries)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(model.score(utf8(batch.column("text")), hits) < TOXIC))

    return docs.mapInArrow(run, docs.schema)


def op7_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see scored() for nulls and empty texts."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
