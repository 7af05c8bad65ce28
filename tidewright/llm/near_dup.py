"""Near duplicates by SetSketch registers.

A register is the exponentially spaced, truncated minimum of exponential variates of the set's elements:
max(0, min(q + 1, floor(1 - log_b x))). Sketches merge by maximum, and equal registers are as likely as the sets
are similar. Texts of equal shingle sets form a class; classes that share a band of registers are candidates.
The joint likelihood of two sketches estimates their similarity, and pairs that may reach the threshold are
verified on full sets. In a band's bucket, members are compared with one of them, and only what then lies in
different components, and may be linked by what the members have beside it, is compared further (_linked()).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, release, settle, slices, table, utf8
from .shingles import WordHashes, lower_words, shingles

#: Base, rate and top register of a sketch.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: Bands and registers a band. Similarity 0.75 misses every band with probability (1 - 0.75 ** 3) ** 42 = 1e-10.
BANDS, ROWS = 42, 3
#: Similarity in percent from which texts are linked.
LEAST = 75
#: Standard deviations by which an estimate may fall short of the threshold before its pair is dropped.
SLACK = 6.0
_rng = np.random.default_rng(20_11)
_MUL, _ADD = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes (not empty)."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max)
    for at in range(0, len(elements), 2048):
        low = np.minimum(low, (np.multiply.outer(_MUL, elements[at : at + 2048]) + _ADD[:, None]).min(axis=1))
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarities of sets of sizes na, nb from rows of registers a, b."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.clip(1 - x - y, 1e-12, 1))

    low, high = np.zeros(len(na)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        s, t = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(s) < likelihood(t)
        low, high = np.where(up, s, low), np.where(up, high, t)
    return (low + high) / 2


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets; null for none), registers (little-endian 16-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches, "text"):
            n, keys, regs = [], [], []
            for text in utf8(batch.column("text")):
                s = np.unique(shingles(words.of(lower_words(text or b""))))
                n.append(len(s))
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                regs.append(registers(s).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """(rep, band): one row for each band of a class's sketch, band numbering what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.frombuffer(b"".join(utf8(batch.column("registers"))), "<u2").reshape(-1, BANDS, ROWS).astype(np.int64)
            keys = np.arange(BANDS) << 48 | r[:, :, 0] << 32 | r[:, :, 1] << 16 | r[:, :, 2]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(batch.column("rep")), BANDS)), pa.array(keys.ravel())], ["rep", "band"])

    return classes.select("rep", "registers").mapInArrow(run, "rep long, band long")


def full_sets(docs: DataFrame) -> DataFrame:
    """(rep, set_key, elements): the sorted shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in slices(batches, "text"):
            sets = [np.unique(shingles(words.of(lower_words(t or b"")))).view(np.int64) for t in utf8(batch.column("text"))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["rep", "set_key", "elements"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, set_key binary, elements array<long>")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sketches leave the threshold possible."""
    c = classes.select("rep", "n", "registers")
    rows = pairs.join(c.toDF("a", "na", "ra"), "a").join(c.toDF("b", "nb", "rb"), "b").where(F.expr(f"100 * least(na, nb) >= {LEAST} * greatest(na, nb)"))
    least = LEAST / 100 - SLACK * (LEAST / 100 * (1 - LEAST / 100) / (BANDS * ROWS)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(utf8(batch.column(k))), "<u2").reshape(batch.num_rows, -1) for k in ("ra", "rb"))
            keep = joint_estimate(ra, rb, np.array(batch.column("na"), float), np.array(batch.column("nb"), float)) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return rows.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the threshold; a may be in many pairs."""
    rows = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    rows = rows.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return rows.where(f"100 * both >= {LEAST} * (na + nb - both)").select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for documents (doc_id, text; other columns are ignored).

    Null, empty and wordless texts have no shingles and are linked with nothing. Rows of one doc_id with
    different texts count their own shingles and are linked by the text of the smallest set_key. A row
    without doc_id is judged alone: component_id is null and kept true. No documents give no rows.
    """
    spark = docs.sparkSession
    sk = settle(sketches(docs), "near-sketches")
    own = sk.where("doc_id is not null and set_key is not null").groupBy("doc_id").agg(F.min(F.struct("set_key", "n_shingles", "registers")).alias("s")).select("doc_id", "s.*")
    classes = own.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("registers").alias("registers"))
    classes = settle(classes, "near-classes")
    rows = bands(classes)
    full = rows.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band")
    shared = settle(rows.join(full, "band"), "near-buckets")
    release(spark)
    wanted = shared.select("rep").distinct().join(classes.select("rep", "set_key"), "rep")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted.select("rep"), "rep", "left_semi")
    sets = full_sets(texts).join(wanted, ["rep", "set_key"], "left_semi").select("rep", "elements")
    sets = settle(sets, "near-sets").dropDuplicates(["rep"]) if _repeats(docs) else settle(sets, "near-sets")
    release(spark)
    comps = _linked(shared, classes, sets)
    homes = own.select("doc_id", "set_key").join(classes.select("set_key", "rep"), "set_key").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    found = sk.select("doc_id", "n_shingles").join(homes, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _linked(buckets: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, component) of all linked classes; buckets (band, rep) hold every pair that may be linked.

    A member's fame is the number of members in its buckets: the text that a crowd was copied from has most.
    First the members of a bucket are compared with its most famous, then, in buckets that still span several
    components, with h, the most famous of the component of that one; h need not be in the bucket. Let x and y
    lie in different components and in a bucket with this h; one of them, say x, is not linked with h. If they share
    no element outside h, then |x & y| <= |x & h|, which allows a link only for a few sizes of y, and those are
    looked up. Otherwise at least LEAST percent of x less |x & h| shared elements lie outside h, so that x and
    y agree in one of the rarest of those.
    """
    spark = buckets.sparkSession
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    fame = buckets.join(sizes, "band").groupBy("rep").agg(F.sum("size").alias("fame"))
    buckets = settle(buckets.join(fame, "rep"), "near-fame")
    first = F.struct((-F.col("fame")).alias("f"), "rep")
    low = buckets.groupBy("band").agg(F.min_by("rep", first).alias("h"))
    pairs = settle(buckets.join(low, "band").where("rep <> h").select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b")).distinct(), "near-pairs")
    edges = settle(verified(likely(pairs, classes), sets), "near-links")
    comps = settle(components(edges, "near"), "near-first")
    release(spark)
    famed = comps.join(fame, comps.id == fame.rep).select("id", "component", "fame")
    tops = famed.groupBy("component").agg(F.min_by("id", F.struct((-F.col("fame")).alias("f"), "id")).alias("top"))
    known = settle(comps.join(tops, "component"), "near-known")
    at = buckets.join(known, buckets.rep == known.id, "left").select("band", "rep", "fame", F.coalesce("component", "rep").alias("comp"), F.coalesce("top", "rep").alias("top"))
    hubs = at.groupBy("band").agg(F.min_by("top", first).alias("h"), F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q")
    at = settle(at.join(hubs, "band").select("band", "rep", "h"), "near-open")
    if not at.limit(1).count():
        return comps
    around = at.where("rep <> h").select("h", "rep").distinct()
    both = around.join(sets.toDF("h", "sh"), "h").join(sets.toDF("rep", "sx"), "rep")
    both = settle(both.select("h", "rep", F.size("sx").alias("n"), F.size("sh").alias("nh"), F.size(F.array_intersect("sx", "sh")).alias("common")), "near-hubs")
    near = F.expr(f"{100 + LEAST} * common >= {LEAST} * (n + nh)")
    more = both.where(near).select(F.least("h", "rep").alias("a"), F.greatest("h", "rep").alias("b"))
    known = components(more, "near", comps)
    release(spark)
    met = both.join(known, both.rep == known.id, "left").select("h", "rep", "n", "common", near.alias("linked"), F.coalesce("component", "rep").alias("comp"))
    # the rarest elements outside h
    rest = met.join(sets.toDF("h", "sh"), "h").join(sets.toDF("rep", "sx"), "rep").select("h", "rep", "linked", "comp", F.array_except("sx", "sh").alias("rest"), F.greatest(F.ceil(F.col("n") * LEAST / 100) - F.col("common"), F.lit(1)).alias("need"))
    each = settle(rest.select("h", "rep", "linked", "comp", "need", F.size("rest").alias("k"), F.explode("rest").alias("e")), "near-rest")
    several = each.groupBy("h", "e").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("p"), F.max("comp").alias("q"))
    order = Window.partitionBy("h", "rep").orderBy("df", "e")
    first = each.join(several, ["h", "e"]).withColumn("place", F.row_number().over(order)).where("place <= k - need + 1 and p <> q")
    first = settle(first.select("h", "e", "rep", "comp", "linked"), "near-prefix")
    meet = first.where("not linked").select("h", "e", F.col("rep").alias("x"), F.col("comp").alias("cx")).join(first, ["h", "e"])
    alike = meet.where("comp <> cx and (linked or x < rep)").select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
    # sizes that need nothing outside h
    most, least = F.floor(F.expr(f"common * {100 + LEAST} / {LEAST} - n")).cast("int"), F.ceil(F.col("n") * LEAST / 100).cast("int")
    small = met.where("not linked").where(most >= least).select("h", F.col("rep").alias("x"), F.col("comp").alias("cx"), F.explode(F.sequence(least, most)).alias("n"))
    sized = small.join(met.select("h", "n", "rep", "comp"), ["h", "n"]).where("comp <> cx").select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
    pairs = settle(alike.unionByName(sized).distinct(), "near-pairs")
    release(spark)
    return components(verified(likely(pairs, classes), sets), "near", known)


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id is on several rows."""
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; see near_duplicates() for nulls, empty texts and repeated doc_ids."""
    return near_duplicates(table(spark, sf_dir, "documents"))
