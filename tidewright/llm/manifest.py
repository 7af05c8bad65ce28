"""Merkle manifest of a dataset: ternary trees per source, a tree over sources, and proofs by pointer jumping.

Leaves are numbered in order within their group. A pass over blocks of 3**5 neighbours builds five levels of all trees;
each node keeps a segment, the digests beside it in its run. Pointer jumping then doubles the distance to the ancestor
that a node knows: it takes its ancestor's segment behind its own. After the round of distance d only levels that 2 * d
divides are asked for again, so the others are left out. An ancestor at distance d has 3**d descendants; it is copied to
its blocks of 3**5, so that no key of a join has more rows than a block.

A segment is a run of steps from the node upwards: one byte (digests to the left, times 4, plus digests to the right) and
then the digests, 32 bytes each, left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, settle_seen, table

#: Children of a node, and levels that one pass builds.
ARITY, LEVELS = 3, 5
BLOCK = ARITY**LEVELS
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value as bytes that no other value has: `-` for null, else its UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(cols: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(cols[c]) for c in FIELDS]).cast("binary"), 256))


def numbered_leaves(leaves: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds `i` (place in its group, gapless from 0) and `n` (leaves of the group).

    Rows are written in ranges of (group, order); a row's place is its offset in the range plus what earlier ranges hold of
    its group. No task needs more than a range and the counts of ranges.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaves.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    own = settle(dealt.withColumn("_at", F.monotonically_increasing_id()), "leaves").withColumn("_p", F.shiftright("_at", 33))
    counts = own.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(w.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_g", "_q", "_first", before.alias("_before"), F.sum("_c").over(w).alias("n"))
    placed = own.join(counts, (F.col(group) == F.col("_g")) & (F.col("_p") == F.col("_q")))
    return placed.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_p", "_g", "_q", "_c", "_first", "_before")


def risen(nodes: DataFrame, group: str, level: int) -> DataFrame:
    """Nodes (group, level, i, n, digest, ..) of one level, and all above them up to LEVELS levels, with their segments `seg`.

    n is the number of leaves of the group. Nodes of the highest level built, and nodes at the top of their tree, have a null
    segment. Further columns stay with the given nodes and are null for new ones.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    more = [c for c in nodes.columns if c not in (group, "level", "i", "n", "digest")]
    names = [group, "level", "i", "n", "digest", "seg", *more]
    kinds |= {"level": "int", "seg": "binary"}
    arrow = pa.schema([(c, {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}[kinds[c]]) for c in names])

    def block(rows: list[tuple], n: int) -> Iterator[tuple]:
        """rows: (group, i, digest, further columns) of one block in order; n nodes has the level."""
        key, empty = rows[0][0], (None,) * len(more)
        total = rows[0][2]
        own = [(r[1], r[3], r[4:]) for r in rows]
        for up in range(LEVELS):
            if n == 1:
                break
            above = []
            for at in range(0, len(own), ARITY):
                run = [d for _, d, _ in own[at : at + ARITY]]
                for k, (i, d, extra) in enumerate(own[at : at + ARITY]):
                    yield key, level + up, i, total, d, bytes([k * 4 + len(run) - 1 - k]) + b"".join(run[:k] + run[k + 1 :]), *extra
                digest = hashlib.sha256("".join([d.hex() for d in run]).encode()).digest()
                above.append((own[at][0] // ARITY, digest, empty))
            own, n = above, -(-n // ARITY)
        else:
            up = LEVELS
        for i, d, extra in own:
            yield key, level + up, i, total, d, None, *extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark, out = [], None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r[0], r[1] // BLOCK) != mark:
                    if held:
                        out.extend(block(held, -(-held[0][2] // ARITY**level)))
                    held, mark = [], (r[0], r[1] // BLOCK)
                    if len(out) >= 20_000:
                        yield _batch(out, arrow)
                        out = []
                held.append(r)
        if held:
            out.extend(block(held, -(-held[0][2] // ARITY**level)))
        if out:
            yield _batch(out, arrow)

    dealt = nodes.select(group, "i", "n", "digest", *more).withColumn("_b", F.floor(F.col("i") / BLOCK))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, group, "_b").sortWithinPartitions(group, "_b", "i").drop("_b")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def grown(leaves: DataFrame, group: str) -> tuple[DataFrame, DataFrame, int]:
    """All nodes below the tops, the tops (group, level, digest), and the height of the highest tree.

    leaves: group (string), i, n, digest (binary) and further columns. A group of one leaf has it as its top and as a node
    with an empty segment.
    """
    at, level, built, tops, height = leaves, 0, [], [], 0
    while True:
        single = (F.col("level") < level + LEVELS) | (F.col("n") <= ARITY ** (level + LEVELS))
        rows, seen = settle_seen(risen(at, group, level), f"tree{level}", high=F.max("level"), leaves=F.max("n"))
        height = max(height, seen.get("high") or 0)
        built.append(rows.where("seg is not null"))
        open_ = rows.where("seg is null")
        tops.append(open_.where(single))
        level += LEVELS
        if (seen.get("leaves") or 0) <= ARITY**level:
            break
        at = open_.where(~single).drop("seg")
    one = lambda frames: frames[0] if len(frames) == 1 else one([frames[0].unionByName(frames[1]), *frames[2:]])
    nodes, top = one(built), one(tops)
    lone = top.where("level = 0").withColumn("seg", F.lit(b"").cast("binary"))
    return nodes.unionByName(lone), top.select(group, "level", "digest"), height


def reached(nodes: DataFrame, ancestors: DataFrame, group: str, d: int, carry: list[str]) -> DataFrame:
    """One jump: nodes whose ancestor at distance d is among `ancestors` take over its segment and its columns of `carry`; the others stay."""
    low = min(d, LEVELS)
    per = ARITY ** (d - low)
    below = F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), F.col("level") - d + low)).cast("long")  # nodes at the distance of the blocks
    first = F.col("i") * per
    blocks = F.explode(F.sequence(first, F.least(first + per - 1, below - 1))) if per > 1 else F.col("i")
    held = ancestors.select(F.col(group).alias("_g"), (F.col("level") - d).alias("_l"), blocks.alias("_b"), F.col("seg").alias("_s"), *[F.col(c).alias(f"_{c}") for c in carry])
    on = (F.col(group) == F.col("_g")) & (F.col("level") == F.col("_l")) & (F.floor(F.col("i") / ARITY**low) == F.col("_b"))
    both = nodes.join(held, on, "left")
    both = both.withColumn("seg", F.when(F.col("_s").isNull(), F.col("seg")).otherwise(F.concat("seg", "_s")))
    for c in carry:
        both = both.withColumn(c, F.coalesce(c, f"_{c}"))
    return both.drop("_g", "_l", "_b", "_s", *[f"_{c}" for c in carry])


def proofs(nodes: DataFrame, ends: DataFrame, group: str, height: int, keep: list[str]) -> DataFrame:
    """Leaves with `seg` up to the root and what the tops carry.

    ends: (group, level, tail, ..): the top of each tree, the segment from there on, and columns that its leaves are to get.
    nodes: see grown(). The top's segment is put behind at the top, so it comes down with the jumps.
    """
    carry = [c for c in ends.columns if c not in (group, "level", "tail")]
    nodes = nodes.select(group, "level", "i", "n", "digest", "seg", *keep)
    blank = [F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in carry]
    lone = nodes.where("level = 0 and n = 1").join(ends.drop("level"), group).withColumn("seg", F.concat("seg", "tail")).drop("tail")
    counts = nodes.where("i = 0").groupBy(group).agg(F.max("n").alias("n"))
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("digest", *keep)]
    tops = ends.where("level > 0").join(counts, group).select(group, "level", F.lit(0).cast("long").alias("i"), "n", none[0], F.col("tail").alias("seg"), *none[1:], *carry)
    own = nodes.where("level > 0 or n > 1").select("*", *blank)
    leaves, inner = own.where("level = 0"), settle(own.where("level > 0").unionByName(tops), "jump0")
    d = 1
    while d <= height:
        leaves = reached(leaves, inner.where(F.col("level") == d), group, d, carry)
        at = F.col("level") % (2 * d)
        was, inner = inner, settle(reached(inner.where(at == 0), inner.where(at == d), group, d, carry), f"jump{2 * d}")
        d *= 2
    return leaves.unionByName(lone.select(leaves.columns))


def folded(segment: bytes, digest: bytes) -> tuple[str, bytes]:
    """SHA-256 of the segment's digests as text, and the root to which the digest leads with them."""
    beside, at = hashlib.sha256(), 0
    while at < len(segment):
        k, right = segment[at] >> 2, segment[at] & 3
        some = [segment[at + 1 + 32 * j : at + 33 + 32 * j].hex() for j in range(k + right)]
        beside.update("".join(some).encode())
        digest = hashlib.sha256("".join([*some[:k], digest.hex(), *some[k:]]).encode()).digest()
        at += 1 + 32 * (k + right)
    return beside.hexdigest(), digest


def manifest(docs: DataFrame, forged: Column | None = None) -> DataFrame:
    """A leaf's row for each document: doc_id, leaf, subroot, root, seg, proof_sha256, folded_root, verified.

    Columns doc_id, source, lang, n_chars and text are hashed, others ignored; nulls are hashed as such, and a null source is a
    group of its own, before all others. `forged`, if given, is the text that is checked against the proofs in place of the
    hashed one. Within a source, rows of one doc_id (null first) follow each other by their digests, so repeated rows keep
    a leaf each. Very long texts are hashed in the JVM, a row at a time. No documents: no rows.
    """
    cols = {c: F.col(c) for c in FIELDS}
    hashed = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(cols).alias("digest"),
        (leaf_digest(cols | {"text": forged}) if forged is not None else F.lit(None).cast("binary")).alias("forged"),
    )
    hashed = settle(hashed.withColumn("forged", F.when(F.col("forged") != F.col("digest"), F.col("forged"))), "digests")
    leaves = numbered_leaves(hashed, "grp", [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    nodes, tops, height = grown(leaves, "grp")
    sources = tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), "level", "digest")
    above = numbered_leaves(sources.select("all", "name", "digest", F.col("level").alias("home")), "all", [F.col("name")])
    crown, root, rise = grown(above, "all")
    root = root.select("all", "level", F.lit(b"").cast("binary").alias("tail"), F.col("digest").alias("root"))
    ends = settle(proofs(crown, root, "all", rise, ["name", "home"]), "sources")
    ends = ends.select(F.col("name").alias("grp"), F.col("home").alias("level"), F.col("seg").alias("tail"), F.col("digest").alias("subroot"), "root")
    got = proofs(nodes, ends, "grp", height, ["doc_id", "forged"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seg, digest, forged = (batch.column(c).to_pylist() for c in ("seg", "digest", "forged"))
            done = [folded(s, f or d) for s, d, f in zip(seg, digest, forged, strict=True)]
            root = batch.column("root").to_pylist()
            text = lambda xs: pa.array([x.hex() for x in xs], pa.string())
            cols = [batch.column("doc_id"), text(digest), text(batch.column("subroot").to_pylist()), text(root), batch.column("seg"), pa.array([p for p, _ in done], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*cols, text([r for _, r in done]), pa.array([a == b for (_, a), b in zip(done, root, strict=True)], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "seg", "proof_sha256", "folded_root", "verified"],
            )

    columns = "doc_id long, leaf string, subroot string, root string, seg binary, proof_sha256 string, folded_root string, verified boolean"
    return got.select("doc_id", "digest", "forged", "subroot", "root", "seg").mapInArrow(fold, columns)


def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, every other one (by a checksum of doc_id) checked with its line breaks taken out; see manifest() for nulls and ties."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    forged = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), forged).drop("seg")


#: crc32 of a decimal number, bit by bit, for engines without that function.
CRC32 = """list_reduce([4294967295::BIGINT] || list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::INT, 1))::BIGINT), lambda c, b:
  list_reduce([xor(c, b)] || range(0, 8), lambda r, s: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"""

ORACLE = """
WITH RECURSIVE f AS (SELECT *, row_number() OVER () AS rid, coalesce('s' || source, '') AS g,
  concat(CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END) AS head,
  CASE WHEN xor(@CRC, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
h AS (SELECT rid, g, doc_id, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  sha256(head || CASE WHEN other IS NULL THEN '-' ELSE strlen(other) || ':' || other END) AS forged FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
t AS (SELECT g, 0 AS level, i, n, leaf AS d FROM p
  UNION ALL SELECT g, level + 1, i // 3, max((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 3),
s AS (SELECT g, level AS high, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, subroot AS d FROM s UNION ALL SELECT level + 1, i // 3, max((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3),
steps AS (SELECT p.rid, t.level, string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < p.i // pow(3, t.level)::BIGINT) AS l, string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > p.i // pow(3, t.level)::BIGINT) AS r
    FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.i // 3 = p.i // pow(3, t.level + 1)::BIGINT GROUP BY ALL
  UNION ALL SELECT p.rid, s.high + u.level, string_agg(u.d, '' ORDER BY u.i) FILTER (u.i < s.i // pow(3, u.level)::BIGINT), string_agg(u.d, '' ORDER BY u.i) FILTER (u.i > s.i // pow(3, u.level)::BIGINT)
    FROM p JOIN s ON s.g = p.g JOIN u ON u.n > 1 AND u.i // 3 = s.i // pow(3, u.level + 1)::BIGINT GROUP BY ALL),
proof AS (SELECT rid, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY rid),
walk AS (SELECT rid, 0 AS level, forged AS d FROM p UNION ALL SELECT w.rid, w.level + 1, sha256(coalesce(x.l, '') || w.d || coalesce(x.r, '')) FROM walk w JOIN steps x ON x.rid = w.rid AND x.level = w.level),
fold AS (SELECT rid, max_by(d, level) AS folded_root FROM walk GROUP BY rid),
top AS (SELECT d AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN s USING (g) CROSS JOIN top LEFT JOIN proof USING (rid) JOIN fold USING (rid)
""".replace("@CRC", CRC32.format(x="doc_id::VARCHAR"))
