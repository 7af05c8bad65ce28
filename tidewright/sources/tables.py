"""Reading the tables, with the few rules that every source shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a DataFrame; file filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, label: str) -> DataFrame:
    """settled() in buckets of a key, as many as the session has shuffle partitions, so that joins and groups on it do not shuffle df again."""
    spark = df.sparkSession
    name, n = f"{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # the cleaner works on its own time
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


def day_files(spark: SparkSession, pattern: str, schema: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """JSON or JSON-lines files whose names or folders carry a date (YYYY-MM-DD; the last counts), with `day`; malformed rows keep their text in _corrupt_record."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(pattern)
    df = df.withColumn("day", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r".*(\d{4}-\d{2}-\d{2})", 1)))
    if first:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    return df.where(F.col("day") <= F.lit(last).cast("date")) if last else df


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of several sources with differing columns; `origin` names the source."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def newest_per_source(df: DataFrame, source: str, at: str, now: str, stale_days: dict[str, int], default: int = 7) -> DataFrame:
    """The newest row of each source, its age in days and whether it is older than the source may be."""
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in stale_days.items() for x in kv]), F.col(source)), F.lit(default)) if stale_days else F.lit(default)
    newest = df.groupBy(source).agg(F.max(at).alias("newest"), F.count(F.lit(1)).alias("n_records"))
    age = F.datediff(F.lit(now).cast("timestamp_ntz"), F.col("newest"))
    return newest.withColumn("age_days", age).withColumn("is_stale", F.col("age_days") > limit)
