"""Fingerprints that outlive a run: a table in buckets by band, with a partition for each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settled
from .dedup import near_fingerprints

FIELDS = "slot int, fingerprint long, key long"


class FingerprintIndex:
    """64-bit fingerprints under a folder, for pairs within `most` bits.

    A fingerprint has a row for each of its bands; rows lie in buckets by band and value, so a later run shuffles only its
    own rows to them. Of equal fingerprints the first one's key stands for all. The folder is all that is needed: any
    session opens the index from it.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 3, bands: int = 4, buckets: int = 64) -> None:
        if not most < bands <= 8 or 64 % bands:
            raise ValueError("bands must exceed the distance and divide 64")
        self.spark, self.path, self.most, self.bands, self.buckets = spark, path, most, bands, buckets
        self.name = "fingerprints_" + path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(folder)
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({FIELDS}, day string) USING parquet PARTITIONED BY (day) CLUSTERED BY (slot) INTO {buckets} BUCKETS LOCATION '{path}'")
            spark.catalog.recoverPartitions(self.name)

    def slots(self) -> Column:
        """A number for each band and its value; where two agree by chance, the distance tells."""
        width = 64 // self.bands
        part = lambda k: F.shiftrightunsigned("fingerprint", k * width).bitwiseAND(F.lit((1 << width) - 1))
        return F.explode(F.array(*[F.hash(F.lit(k), part(k)) for k in range(self.bands)])).alias("slot")

    def matches(self, new: DataFrame) -> DataFrame:
        """(a, b, distance): stored key, key of `new` (key, fingerprint), for all stored fingerprints within the distance."""
        old = self.spark.table(self.name).select("slot", F.col("fingerprint").alias("_f"), F.col("key").alias("a"))
        d = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("_f"))).cast("int")
        own = new.select(F.col("key").alias("b"), "fingerprint", self.slots())
        return own.join(old.hint("merge"), "slot").select("a", "b", d.alias("distance")).where(F.col("distance") <= self.most).distinct()

    def run(self, new: DataFrame, day: str) -> DataFrame:
        """Pairs (a, b, distance) that rows (key, fingerprint) make with what is stored and among themselves; new fingerprints are stored under `day`.

        A row whose fingerprint is known pairs with the known key alone. Runs over parts, in ascending order of keys, give
        what near_fingerprints() gives over all rows. Rows without a fingerprint pair with nothing.
        """
        new = settled(new.where("fingerprint is not null").select("key", "fingerprint"), "new-fingerprints")
        groups = new.groupBy("fingerprint").agg(F.min("key").alias("key"))
        found = settled(self.matches(groups), "matches")
        known = found.where("distance = 0").select("a", F.col("b").alias("rep"))
        fresh = settled(groups.join(known, F.col("key") == F.col("rep"), "left_anti"), "fresh")
        of_known = new.join(groups.join(known, F.col("key") == F.col("rep")).select("a", F.col("fingerprint").alias("_f")), F.col("fingerprint") == F.col("_f"))
        of_known = of_known.select("a", F.col("key").alias("b"), F.lit(0).alias("distance"))
        near = found.join(fresh.select(F.col("key").alias("b")), "b", "left_semi").select("a", "b", "distance")
        own = near_fingerprints(new.join(fresh.select("fingerprint"), "fingerprint", "left_semi").select("key", "fingerprint"), "key", self.most, self.bands)
        pairs = settled(of_known.unionByName(near).unionByName(own), "pairs")
        rows = fresh.select(self.slots(), "fingerprint", "key", F.lit(day).alias("day")).repartition(self.buckets, "slot")
        rows.write.mode("append").partitionBy("day").bucketBy(self.buckets, "slot").option("path", self.path).saveAsTable(self.name)
        return pairs

    def forget(self, before: str) -> int:
        """Drop all days before one, table entries and files; returns how many."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        old = [r[0] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect() if r[0].split("=", 1)[1] < before]
        for part in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (day = '{part.split('=', 1)[1]}')")
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            folder.getFileSystem(conf).delete(folder, True)
        return len(old)
