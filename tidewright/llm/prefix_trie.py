"""Prefix trie of conversations from a sorted order: range minima over common prefixes, without a stack.

Conversations are sorted by their turns' digests, so that the members of a prefix are neighbours; l[r] is the number of
turns that rank r shares with the rank before. Every rank with l[r] > 0 proposes the prefix of that length. Its members
reach left and right as far as l stays at or above the length: two independent binary searches over range minima. A
prefix that an earlier rank of the same interval proposes as well is left to that one.

Ranks are dealt in blocks. A task keeps a sparse table of its block's minima; a search that leaves its block goes on over
the minima of blocks, which are dealt in blocks again, and comes back to the one block in which it ends. Minima and sums
over intervals go the same way. So no task holds more than a block, however many conversations share a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, settle_seen, table
from .manifest import CRC32

#: Ranks of a block, and bytes of a turn's digest.
BLOCK, WIDTH = 4096, 16
#: Turns that a conversation may take over from the first one of its hundred.
MOST_SHARED = 5
#: Aggregates over intervals of ranks: the least conv_id, the number of leaves, tokens saved.
LEAST, LEAVES, SAVED = 0, 1, 2
TOP = np.iinfo(np.int64).max
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): each conversation after its first turns gave way to those of the first one of its hundred.

    key has a digest of role and text for each turn, sizes the code points of each text. Turns are ordered by number (null
    first), equal numbers by digest; a null role or text is empty; rows without a conv_id belong to no conversation. Texts
    stay where they are read; a conversation's digests are one value, 16 bytes for each turn.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    each = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has"), "turn", F.substring(F.sha2(framed, 256), 1, 2 * WIDTH).alias("digest"), F.length(text).alias("size")
    )
    own = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("has", "turn", "digest", "size"))).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("own"))
    first = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, MOST_SHARED).alias("first"))
    both = own.join(first, F.col("conv_id") - F.col("conv_id") % 100 == F.col("base"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    rest = F.slice("own", h + 1, F.size("own"))
    whole = F.when(F.col("base").isNull(), rest).otherwise(F.concat(F.slice("first", F.lit(1), h), rest))
    both = both.select("conv_id", whole.alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    if a == b:
        return len(a) // WIDTH
    at, end = 0, min(len(a), len(b))
    while at < end and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


def sorted_ranks(convs: DataFrame) -> DataFrame:
    """(rank, conv_id, len, l, next, sizes, whole): conversations in the order of keys, then of conv_id.

    l is the number of turns shared with the rank before (-1 for the first), next the same with the rank after. Ranges are
    sorted by themselves; their first and last keys, two for each range, give what goes across.
    """
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last, held = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            out = held
            for conv, key, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = None if last is None else shared(last, key)
                if out:
                    out[-1][4] = own
                out.append([at, conv, len(key) // WIDTH, own, None, sizes, hashlib.md5(key).digest(), key if last is None else None])
                at, last = at + 1, key
            held = out[-1:]
            if len(out) > 1:
                yield ranked_batch(part, out[:-1])
        if held:
            yield ranked_batch(part, [*held, [-1, at, 0, None, None, [], None, last]])  # the mark has the range's size and last key

    def ranked_batch(part: int, rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        arrays = [pa.array([part] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, ["part", "at", "conv_id", "len", "l", "next", "sizes", "whole", "edge"])

    dealt = convs.select("conv_id", "key", "sizes").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    schema = "part long, at long, conv_id long, len long, l long, next long, sizes array<int>, whole binary, edge binary"
    rows = settle(dealt.mapInArrow(run, schema), "ranked")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("before").to_pylist(), batch.column("first").to_pylist()
            own = pa.array([-1 if x is None else shared(x, y) for x, y in zip(a, b, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("offset"), own], ["part", "offset", "l"])

    edges = rows.where("edge is not null").groupBy("part").agg(
        F.max(F.when(F.col("at") == -1, F.col("conv_id"))).alias("n"), F.max(F.when(F.col("at") == -1, F.col("edge"))).alias("last"), F.max(F.when(F.col("at") == 0, F.col("edge"))).alias("first")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("part")  # a row for each range
    edges = edges.select("part", "first", F.lag("last").over(w).alias("before"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    edges = edges.mapInArrow(across, "part long, offset long, l long")
    edges = edges.select(F.col("part").alias("p"), "offset", F.col("l").alias("l0"), F.coalesce(F.lead("l").over(w), F.lit(-1)).alias("next0"))
    own = rows.where("at >= 0").join(edges, F.col("part") == F.col("p"))
    return own.select((F.col("offset") + F.col("at")).alias("rank"), "conv_id", "len", F.coalesce("l", "l0").alias("l"), F.coalesce("next", "next0").alias("next"), "sizes", "whole")


def in_blocks(rows: DataFrame, answer: Callable, schema: str) -> DataFrame:
    """answer(block, values, asks) for each block; rows (b, ask, x, y, z, q) are long numbers but for ask.

    Values and asks come as arrays of columns x, y, z, q in order of x. answer gives arrays for the columns of `schema`.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(part: np.ndarray) -> pa.RecordBatch:
            values, asks = part[part[:, 1] == 0], part[part[:, 1] == 1]
            got = answer(int(part[0, 0]), values[:, 2:].T, asks[:, 2:].T)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in got], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.column_stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            own = own if held is None else np.concatenate([held, own])
            cuts = np.flatnonzero(np.diff(own[:, 0])) + 1
            for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True) if len(cuts) else ():
                yield done(own[a:b])
            held = own[cuts[-1] :] if len(cuts) else own
        if held is not None:
            yield done(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("b", "ask", "x", "y", "z", "q").repartition(parts, "b").sortWithinPartitions("b", "ask", "x")
    return dealt.mapInArrow(run, schema)


def minima(v: np.ndarray) -> list[np.ndarray]:
    """Sparse table: minima of 1, 2, 4, .. values from each place on."""
    out = [v]
    while 2 << len(out) - 1 <= len(v):
        half = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def first_below(v: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The first place at or after each start whose value is below the bound (len(v) if none), by halving steps over minima."""
    at = start.copy()
    for k, low in reversed(list(enumerate(minima(v)))):
        fits = at + (1 << k) <= len(v)
        go = np.flatnonzero(fits)
        go = go[low[at[go]] >= bound[go]]
        at[go] += 1 << k
    return at


def nearest_below(values: DataFrame, asks: DataFrame, n: int) -> DataFrame:
    """asks (pos, bound, left, tag) with the nearest place before (left = 1) or after pos whose value is below bound: at, v.

    values: (pos, v), pos gapless from 0, n of them. An ask without such a place has null at.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    zero = F.lit(0).cast("long")
    own = values.select(block("pos").alias("b"), F.lit(False).alias("ask"), F.col("pos").alias("x"), F.col("v").cast("long").alias("y"), zero.alias("z"), zero.alias("q"))
    given = asks.select(block("pos").alias("b"), F.lit(True).alias("ask"), F.col("pos").alias("x"), F.col("bound").cast("long").alias("y"), F.col("left").cast("long").alias("z"), F.col("tag").cast("long").alias("q"))

    def answer(b: int, held: np.ndarray, want: np.ndarray) -> list[np.ndarray]:
        v, base = held[1], b * BLOCK
        at = np.full(want.shape[1], -1, np.int64)
        for left in (0, 1):
            k = np.flatnonzero(want[2] == left)
            own = want[0][k] - base  # -1 and len(v) stand for the block's edges
            got = first_below(v[::-1] if left else v, len(v) - own if left else own + 1, want[1][k])
            found = got < len(v)
            at[k[found]] = (len(v) - 1 - got if left else got)[found]
        worth = np.where(at >= 0, v[np.maximum(at, 0)], 0)
        rows = [np.zeros(len(at)), *want, np.where(at >= 0, at + base, -1), worth]
        low = [[1], [b], [v.min()], [0], [0], [0], [0]]
        return [np.concatenate([a, c]) for a, c in zip(rows, low, strict=True)]

    schema = "kind long, pos long, bound long, left long, tag long, at long, v long"
    got = in_blocks(own.unionByName(given), answer, schema)
    found = [F.when(F.col("at") >= 0, F.col(c)).alias(c) for c in ("at", "v")]
    if n <= BLOCK:
        return settle(got.where("kind = 0").select("pos", "bound", "left", "tag", *found), "searched")
    got = settle(got, "searched")
    answers = got.where("kind = 0").select("pos", "bound", "left", "tag", *found)
    open_ = answers.where("at is null").drop("at", "v").withColumn("b", block("pos"))
    lows = got.where("kind = 1").select("pos", F.col("bound").alias("v"))
    far = nearest_below(lows, open_.select(F.col("b").alias("pos"), "bound", "left").distinct().withColumn("tag", F.lit(0)), -(-n // BLOCK))
    edge = F.when(F.col("left") == 1, (F.col("at") + 1) * BLOCK).otherwise(F.col("at") * BLOCK - 1)
    into = far.where("at is not null").select(F.col("at").alias("b"), F.lit(True).alias("ask"), edge.alias("x"), F.col("bound").alias("y"), F.col("left").alias("z"), F.col("pos").alias("q"))
    near = in_blocks(_values_of(own, into), answer, schema).where("kind = 0")
    near = settle(near.select(F.col("tag").alias("_b"), F.col("bound").alias("_t"), F.col("left").alias("_z"), "at", "v"), "found")
    late = open_.join(near, (F.col("b") == F.col("_b")) & (F.col("bound") == F.col("_t")) & (F.col("left") == F.col("_z")), "left")
    return answers.where("at is not null").unionByName(late.select(answers.columns))


def _values_of(values: DataFrame, asks: DataFrame) -> DataFrame:
    """asks and the values of the blocks that they ask."""
    some = asks.select("b").distinct()
    return values.join(some, "b", "left_semi").select(asks.columns).unionByName(asks)


def over_intervals(values: DataFrame, asks: DataFrame, n: int) -> DataFrame:
    """asks (q, kind, a, b) with the least (kind 0) or the sum (other kinds) of the values (kind, pos, v) from a to b: (q, kind, v).

    Places without a value count as nothing; an interval has a <= b + 1 (empty if so).
    """
    lane = lambda place, kind: F.col(place) * 4 + F.col(kind)
    zero, size = F.lit(0).cast("long"), F.lit(BLOCK).cast("long")
    own = values.select((F.floor(F.col("pos") / BLOCK) * 4 + F.col("kind")).alias("b"), F.lit(False).alias("ask"), F.col("pos").alias("x"), F.col("v").cast("long").alias("y"), zero.alias("z"), zero.alias("q"))
    w = asks.where("a <= b").withColumn("ba", F.floor(F.col("a") / BLOCK).cast("long")).withColumn("bb", F.floor(F.col("b") / BLOCK).cast("long"))
    piece = lambda k, low, high: F.struct(F.col(k).alias("blk"), low.alias("x"), high.alias("y"))
    one = F.array(piece("ba", F.col("a"), F.col("b")))
    two = F.array(piece("ba", F.col("a"), (F.col("ba") + 1) * size - 1), piece("bb", F.col("bb") * size, F.col("b")))
    local = w.select("q", "kind", F.explode(F.when(F.col("ba") == F.col("bb"), one).otherwise(two)).alias("p")).select("q", "kind", "p.*")
    local = local.select(lane("blk", "kind").alias("b"), F.lit(True).alias("ask"), "x", "y", F.col("kind").cast("long").alias("z"), "q")

    def answer(b: int, held: np.ndarray, want: np.ndarray) -> list[np.ndarray]:
        blk, kind = divmod(b, 4)
        v = np.full(BLOCK, TOP if kind == LEAST else 0, np.int64)
        v[held[0] - blk * BLOCK] = held[1]
        low, high = want[0] - blk * BLOCK, want[1] - blk * BLOCK
        if kind == LEAST:
            lows, k = minima(v), np.log2(high - low + 1).astype(np.int64)
            got = np.zeros(len(low), np.int64)
            for j in np.unique(k):
                some = k == j
                got[some] = np.minimum(lows[j][low[some]], lows[j][high[some] + 1 - (1 << j)])
        else:
            upto = np.append(0, np.cumsum(v))
            got = upto[high + 1] - upto[low]
        total = v.min() if kind == LEAST else v.sum()
        return [np.append(np.zeros(len(got)), 1), np.append(want[3], blk), np.append(np.full(len(got), kind), kind), np.append(got, total)]

    got = settle(in_blocks(own.unionByName(local), answer, "total long, q long, kind long, v long"), "intervals")
    parts = got.where("total = 0").drop("total")
    if n > BLOCK:
        totals = got.where("total = 1").select("kind", F.col("q").alias("pos"), "v")
        far = w.where("bb - ba > 1").select("q", "kind", (F.col("ba") + 1).alias("a"), (F.col("bb") - 1).alias("b"))
        parts = parts.unionByName(over_intervals(totals, far, -(-n // BLOCK)).select("q", "kind", "v"))
    return parts.groupBy("q", "kind").agg(F.when(F.col("kind") == LEAST, F.min("v")).otherwise(F.sum("v")).alias("v"))


def end_hashes(ranks: DataFrame) -> DataFrame:
    """(first, ends): by the first rank of each group of equal conversations, SHA-256 of their conv_ids, ascending and joined by commas.

    Blocks of ids are joined where they lie; one task then feeds a group's blocks to the hash, in order and one at a time.
    """
    pieces = ranks.groupBy("whole", F.floor(F.col("rank") / BLOCK).alias("blk")).agg(F.min("rank").alias("first"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("whole", "blk", "first", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, digest, out = None, None, None, []
        for batch in batches:
            for whole, at, ids in zip(*(batch.column(c).to_pylist() for c in ("whole", "first", "ids")), strict=True):
                if whole != now:
                    if now is not None:
                        out.append((first, digest.hexdigest()))
                    now, first, digest = whole, at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["first", "ends"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([digest.hexdigest()])], ["first", "ends"])

    parts = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "whole").sortWithinPartitions("whole", "blk").mapInArrow(fold, "first long, ends string")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text; other columns are ignored), a row for each node.

    Columns as in op13. Nulls, equal turn numbers and repeated rows: see rebuilt(). Texts of any length are only hashed and
    measured. Without conversations there is no node, not even the root.
    """
    spark = turns.sparkSession
    leaf = (F.col("len") > 0) & (F.col("next") < F.col("len"))
    ranks, seen = settle_seen(sorted_ranks(settle(rebuilt(turns), "rebuilt")), "ranks", n=F.count(F.lit(1)), least=F.min("conv_id"), leaves=F.count(F.when(leaf, 1)), short=F.min("len"))
    n = seen.get("n") or 0
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in COLUMNS[:-1]) + ", ends_sha256 string")
    end = spark.createDataFrame([(n, -1)], "pos long, v long")
    lengths = ranks.select(F.col("rank").alias("pos"), F.col("l").alias("v")).unionByName(end)
    proposed = ranks.where("l > 0").select(F.col("rank").alias("pos"), F.explode(F.array(*[
        F.struct((F.col("l") + more).alias("bound"), F.lit(left).alias("left"), F.lit(tag).alias("tag")) for more, left, tag in ((0, 1, 0), (1, 1, 1), (0, 0, 2))
    ])).alias("s")).select("pos", "s.*")
    got = nearest_below(lengths, proposed, n + 1)
    pick = lambda tag, c: F.max(F.when(F.col("tag") == tag, F.col(c)))
    seeks = got.groupBy("pos").agg(
        pick(0, "bound").alias("high"), pick(0, "at").alias("left"), pick(0, "v").alias("left_v"), pick(1, "at").alias("same"), pick(2, "at").alias("after"), pick(2, "v").alias("after_v")
    )
    seeks = settle(seeks, "seeks")
    start = seeks.select(F.col("pos").alias("_pos"), F.col("left").alias("_left"))
    low = F.greatest("left_v", "after_v", F.lit(0))
    kin = seeks.where("same = left").select("pos", F.col("left").alias("first"), (F.col("after") - 1).alias("last"), "high", low.alias("low"), (F.col("after") - F.col("left")).alias("n"), "left_v")
    kin = kin.join(start, F.col("first") == F.col("_pos"), "left").withColumn("up", F.when(F.col("left_v") < F.col("low"), F.col("first")).otherwise(F.col("_left"))).drop("_pos", "_left", "left_v")
    own = ranks.select(F.col("rank").alias("first"), F.col("len").alias("first_len"), "sizes")
    part = F.slice("sizes", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    kin = kin.join(own, "first").withColumn("sizes", part)
    worth = (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    kin = settle(kin.withColumn("worth", worth), "shared")

    long = lambda c: F.lit(c).cast("long")
    values = ranks.select(long(LEAST).alias("kind"), F.col("rank").alias("pos"), F.col("conv_id").alias("v"))
    values = values.unionByName(ranks.where(leaf).select(long(LEAVES).alias("kind"), F.col("rank").alias("pos"), long(1).alias("v")))
    values = values.unionByName(kin.where("worth > 0").select(long(SAVED).alias("kind"), "pos", F.col("worth").alias("v")))
    span = lambda kind, a: F.struct(long(kind).alias("kind"), a.alias("a"), F.col("last").alias("b"))
    asked = kin.select(F.col("pos").alias("q"), F.explode(F.array(span(LEAST, F.col("first")), span(LEAVES, F.col("first")), span(SAVED, F.col("first") + 1))).alias("s")).select("q", "s.*")
    found = over_intervals(values, asked, n)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("v")))
    found = found.groupBy("q").agg(of(LEAST).alias("least"), of(LEAVES).alias("leaves"), of(SAVED).alias("saved"))
    kin = settle(kin.join(found, F.col("pos") == F.col("q")).drop("q"), "measured")

    bottom = F.greatest("l", "next", F.lit(0))
    single = ranks.select("rank", "conv_id", "len", "l", bottom.alias("low")).where("len > low").join(start, F.col("rank") == F.col("_pos"), "left")
    single = single.select("rank", "conv_id", "len", "low", F.when(F.col("l") < F.col("low"), F.col("rank")).otherwise(F.col("_left")).alias("up"))
    # a parent may have very many children: it is copied to the blocks in which they lie
    kids = kin.select(F.lit(False).alias("lone"), F.col("pos").alias("id"), "up", "low").unionByName(single.select(F.lit(True).alias("lone"), F.col("rank").alias("id"), "up", "low"))
    lots = kids.withColumn("blk", F.floor(F.col("id") / BLOCK)).groupBy("up", "low", "blk").agg(F.count(F.lit(1)).alias("kids"))
    lots = settle(lots.where("low > 0"), "lots")
    parents = kin.select(F.col("first").alias("_f"), F.col("high").alias("_h"), F.col("least").alias("parent"))
    homes = lots.join(parents, (F.col("up") == F.col("_f")) & (F.col("low") == F.col("_h"))).select(F.col("up").alias("_up"), F.col("low").alias("_low"), F.col("blk").alias("_blk"), "parent")
    children = lots.groupBy(F.col("up").alias("_up"), F.col("low").alias("_low")).agg(F.sum("kids").alias("kids"))

    def with_parent(df: DataFrame, at: str) -> DataFrame:
        on = (F.col("up") == F.col("_up")) & (F.col("low") == F.col("_low")) & (F.floor(F.col(at) / BLOCK) == F.col("_blk"))
        return df.join(homes, on, "left").drop("_up", "_low", "_blk").withColumn("parent", F.coalesce("parent", F.lit(seen.get("least"))))

    none = F.sha2(F.lit("").cast("binary"), 256)
    depth = lambda high: F.explode(F.sequence(F.col("low") + 1, F.col(high))).alias("depth")
    tails = with_parent(single, "rank").select("conv_id", "len", "low", "parent", depth("len")).select(
        "conv_id", "depth", F.when(F.col("depth") - 1 > F.col("low"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), long(1).alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )
    groups = settle(end_hashes(ranks.where("l = len or next = len or len = 0")), "ends")
    stems = with_parent(kin, "pos").join(children, (F.col("first") == F.col("_up")) & (F.col("high") == F.col("_low")), "left").drop("_up", "_low")
    ends = groups.withColumnRenamed("first", "_first")
    stems = stems.join(ends, (F.col("first") == F.col("_first")) & (F.col("first_len") == F.col("high")), "left")
    stems = stems.select("pos", "low", "high", "n", "least", "leaves", "saved", "parent", "kids", "ends", F.posexplode("sizes").alias("k", "size"))
    above = F.coalesce(F.sum("size").over(Window.partitionBy("pos").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stems = stems.withColumn("depth", F.col("low") + F.col("k") + 1).withColumn("above", above)
    last = F.col("depth") == F.col("high")
    stems = stems.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") - 1 > F.col("low"), F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("kids", long(0))).otherwise(long(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"), F.when(last, F.coalesce("ends", none)).otherwise(none).alias("ends_sha256"),
    )
    turnless = groups.where("first = 0") if seen["short"] == 0 else groups.limit(0)
    facts = [kids.where("low = 0").agg(F.count(F.lit(1)).alias("kids")), kin.agg(F.sum("worth").alias("saved")), turnless.select("ends")]
    facts = facts[0].unionByName(facts[1], allowMissingColumns=True).unionByName(facts[2], allowMissingColumns=True)
    root = facts.agg(F.coalesce(F.max("kids"), long(0)).alias("n_children"), F.coalesce(F.max("saved"), long(0)).alias("saved_tokens"), F.coalesce(F.max("ends"), none).alias("ends_sha256"))
    given = {"conv_id": seen["least"], "depth": 0, "parent_conv_id": None, "n_convs": n, "n_leaves": max(1, seen["leaves"])}
    return tails.unionByName(stems).unionByName(root.select("*", *[long(v).alias(c) for c, v in given.items()])).select(*COLUMNS)


def op13_interval_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations; see rebuilt() and prefix_nodes() for nulls, ties and empty tables."""
    return prefix_nodes(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, xor(@CRC, 4294967295) % 6 AS h FROM t),
r AS (SELECT c.conv_id, t.k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k <= h
  UNION ALL SELECT c.conv_id, t.k + 10, role, text FROM c JOIN t USING (conv_id) WHERE t.k > h),
q AS (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY k) AS s, list(length(text) ORDER BY k) AS n FROM r GROUP BY 1),
a AS (SELECT conv_id, coalesce(s, []) AS s, coalesce(n, []) AS n FROM c LEFT JOIN q USING (conv_id)),
m AS (SELECT conv_id, s, d, s[1:d] AS p, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM a)),
v AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM m GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM v WHERE d > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM v LEFT JOIN kids ON kids.p = v.p),
sub AS (SELECT p[1:u] AS p, sum((n - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM w) GROUP BY 1)
SELECT w.conv_id, w.d::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sub ON sub.p = w.p LEFT JOIN v up ON w.d > 0 AND up.p = w.p[1:w.d - 1]
""".replace("@CRC", CRC32.format(x="conv_id::VARCHAR"))
