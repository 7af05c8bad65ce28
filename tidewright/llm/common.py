"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a distributed ranking may hold on average.
BUCKET_ROWS = 20_000


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; an own one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def settle(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*settled: DataFrame) -> None:
    """Delete what settle() wrote for these frames; nothing may read them any more."""
    for df in settled:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # the cleaner works on its own time
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about `most` bytes of the column `text` (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        at = held = 0
        for k, n in enumerate(size):
            if held and held + n > most:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def ranked(df: DataFrame, key: str, bucket: Column, order: list, out: str = "rank") -> DataFrame:
    """Add `out`: the place of each row among the rows of its `key`, gapless from 0.

    Rows are ordered by `bucket` (a whole number), then by `order`. Counts of (key, bucket) give each
    bucket its offset, so that no task sorts all rows of a key. key and bucket must not be null.
    """
    dealt = df.withColumn("_b", bucket)
    before = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_k", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    own = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)))
    joined = own.join(offsets, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_b", "_k", "_c", "_off", "_rn")


def dealt_table(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """settle() in n buckets by `key`, so that joins on it do not shuffle df again."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{scratch(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def settle_seen(df: DataFrame, label: str, **seen: Column) -> tuple[DataFrame, dict]:
    """settle() and aggregates of df (not distinct ones), taken while it is written."""
    watch = Observation(label)
    out = settle(df.observe(watch, *[c.alias(k) for k, c in seen.items()]), label)
    return out, watch.get


def components(edges: DataFrame, label: str, known: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id reachable.

    Alternating large-star and small-star rounds over (child, parent) rows: every group is reduced by a
    min before anything is joined, and the rows of a hot node stay rows. A round that leaves all rows as they
    were ends it, for then all are stars. Nodes without edges do not appear. With `known`, an earlier
    result, edges need only hold what came since: both ends give way to their components first.
    """
    if known is not None:
        home = known.select(F.col("id").alias("k"), F.col("component").alias("c"))
        for end in ("a", "b"):
            edges = edges.join(home, F.col(end) == F.col("k"), "left").withColumn(end, F.coalesce("c", end)).drop("k", "c")
        joined = components(edges, label, None, most_rounds).select(F.col("id").alias("k"), F.col("component").alias("c"))
        moved = known.join(joined, F.col("component") == F.col("k"), "left").select("id", F.coalesce("c", "component").alias("component"))
        return settle(moved.unionByName(joined.join(known, F.col("k") == F.col("id"), "left_anti").toDF("id", "component")), f"{label}-components")
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    marks = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    e, seen = settle_seen(edges.select("a", "b").where("a <> b").distinct(), f"{label}-edges", **marks)
    for _ in range(most_rounds if seen["n"] else 0):
        pairs = both(e)
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = pairs.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = down.join(least, F.col("a") == F.col("k"))
        after = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        was, before = e, seen
        e, seen = settle_seen(after, f"{label}-edges", **marks)
        discard(was)
        if seen == before:
            break
    else:
        if seen["n"]:
            raise RuntimeError(f"components of {label} did not settle in {most_rounds} rounds")
    top = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(top)
