"""Sharding: balanced label propagation under capacity quotas.

Rows start in shards of equal count. In each round a group's rows vote for the shard that holds most of the
group and still has room; rows elsewhere ask to move there, and each shard admits requests up to its quota
in a fixed order. Rows without links fill what the linked rows leave. So links are cut only where a group is
larger than the room of a shard, and counts of any two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, discard, ranked, settle, settle_seen, table


def _at(values: list[int], index: str):
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col(index) + 1)


def _counts(df: DataFrame, column: str, n: int) -> list[int]:
    """Rows of each shard; n_shards rows come to the driver at most."""
    got = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [got.get(s, 0) for s in range(n)]


def propagate(nodes: DataFrame, links: DataFrame, n_shards: int = 40, rounds: int = 16) -> DataFrame:
    """Shard for each node: (node, shard, cut), cut being true where a group's rows lie in several shards.

    nodes: column node (long, unique, not null). links: columns node and grp (not null): rows of one grp are
    linked, each node in one grp at most. Empty nodes give an empty result. Every group, however large, is
    only counted by (grp, shard), joined with written tables (so that Spark can split a large key) and admitted
    by a bucketed ranking. Rounds end when no group asks to move, or after `rounds`; counts hold either way.
    """
    n = nodes.count()
    buckets = max(64, n // BUCKET_ROWS)
    mix = lambda c, m: F.pmod(F.xxhash64(*c), F.lit(m))
    sizes = settle(links.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shard-groups")
    linked = links.join(sizes, "grp").select("node", "grp")
    placed = ranked(nodes.select("node").withColumn("all", F.lit(0)), "all", mix(["node"], buckets), ["node"]).join(linked, "node", "left")
    placed = settle(placed.select("node", "grp", F.floor(F.col("rank") * n_shards / max(n, 1)).cast("int").alias("shard")), "shard-start")
    caps = _counts(placed, "shard", n_shards)
    state = placed.where("grp is not null")
    for k in range(rounds):
        votes = state.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
        room = [c - h for c, h in zip(caps, _counts(state, "shard", n_shards), strict=True)]
        weight = F.struct("n", F.xxhash64("grp", "shard").alias("h"), F.col("shard").alias("s"))
        to = F.max(F.when(_at(room, "shard") > 0, weight)).over(Window.partitionBy("grp"))  # n_shards rows of a group at most
        wishes, seen = settle_seen(votes.withColumn("to", to).where(F.col("to") > weight).select("grp", "shard", F.col("to.s").alias("to")), f"shard-wishes{k}", n=F.count(F.lit(1)))
        if not seen.get("n"):
            break
        want = settle(state.join(wishes, ["grp", "shard"], "left").select("node", "grp", "shard", "to"), f"shard-wants{k}")
        order = mix(["grp"], 1 << 20) * buckets + mix(["node"], buckets)
        asks = ranked(want.where("to is not null"), "to", order, ["node"])
        asks = asks.withColumn("shard", F.when(F.col("rank") < _at(room, "to"), F.col("to")).otherwise(F.col("shard")))
        was, state = state, settle(want.where("to is null").select("node", "grp", "shard").unionByName(asks.select("node", "grp", "shard")), f"shard-round{k}")
        discard(want, wishes, *([was] if k else []))
    room = [c - h for c, h in zip(caps, _counts(state, "shard", n_shards), strict=True)]
    free = ranked(placed.where("grp is null").select("node", "shard"), "shard", mix(["node"], buckets), ["node"])
    free = settle(free.withColumn("stays", F.col("rank") < _at(room, "shard")).drop("rank"), "shard-fill")
    stay = _counts(free.where("stays"), "shard", n_shards)
    upto, ends = 0, []
    for r, s in zip(room, stay, strict=True):
        upto += r - s
        ends.append(upto)
    over = ranked(free.where("not stays").select("node").withColumn("all", F.lit(0)), "all", mix(["node"], buckets), ["node"])
    over = over.select("node", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank"))).alias("shard"))
    cut = settle(state.groupBy("grp").agg((F.min("shard") != F.max("shard")).alias("cut")), "shard-cuts")
    rest = free.where("stays").select("node", "shard").unionByName(over)
    return settle(state.join(cut, "grp").select("node", "shard", "cut").unionByName(rest.withColumn("cut", F.lit(False))), "shard-end")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Shards and slots for documents (doc_id, text; other columns are ignored); rows of equal text are linked.

    size is the UTF-8 bytes of the text plus 16; a null text has size 16, checksum 0 and no links; an empty
    text is linked with other empty texts. Repeated rows and null doc_ids keep one result row each.
    """
    nodes = settle(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("node"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.md5(F.col("text").cast("binary")).alias("grp"),
        ), "shard-nodes",
    )
    homes = propagate(nodes, nodes.where("grp is not null").select("node", "grp"), n_shards)
    n = nodes.count()
    slots = ranked(homes, "shard", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(max(8, n // n_shards // BUCKET_ROWS))), ["node"], "slot")
    return nodes.join(slots, "node").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cut")


def op1_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the law `rows`; see shard_documents() for nulls, empty texts and repeated rows."""
    return shard_documents(table(spark, sf_dir, "documents"), 40)
