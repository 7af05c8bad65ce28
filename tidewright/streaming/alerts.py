"""A store of alerts that a stream merges into: created, updated, escalated, silenced, expired; safe to deliver twice.

Each micro-batch reads the version of the store before it and writes its own, its history and what it closed under its
batch id. A batch that comes again finds the same version before it and overwrites the same folders, so it changes
nothing. All steps are joins and aggregates over (bucket, kind); nothing but one time comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities in ascending order.
LEVELS = ("low", "medium", "high", "critical")
OPEN = "alert_id string, bucket string, kind string, level int, first_detected timestamp_ntz, last_updated timestamp_ntz, weeks_persistent int, silent_until timestamp_ntz, n_sent int"
CLOSED = OPEN + ", expired_at timestamp_ntz"
HISTORY = "alert_id string, bucket string, kind string, event string, at timestamp_ntz, old int, new int"


class AlertStore:
    """Alerts in a shared folder. An alert not renewed for `stale_days` expires; one that was sent is silent for `hold_days` unless it escalates."""

    def __init__(self, spark: SparkSession, path: str, stale_days: int = 56, hold_days: int = 7) -> None:
        self.spark, self.path, self.stale, self.hold = spark, path, stale_days, hold_days

    def _folders(self, kind: str) -> dict[int, str]:
        """Complete versions by batch id."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return {}
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
        whole = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName().split("=")[1]): p.toString() for p in whole}

    def _read(self, kind: str, schema: str, before: int | None = None) -> DataFrame:
        folders = {b: p for b, p in self._folders(kind).items() if before is None or b < before}
        if kind == "open" and folders:
            folders = {b: p for b, p in folders.items() if b == max(folders)}
        return self.spark.read.schema(schema).parquet(*folders.values()) if folders else self.spark.createDataFrame([], schema)

    def open(self, before: int | None = None) -> DataFrame:
        """Alerts that are alive, after all batches or before one."""
        return self._read("open", OPEN, before)

    def closed(self) -> DataFrame:
        return self._read("closed", CLOSED)

    def history(self) -> DataFrame:
        return self._read("history", HISTORY)

    def merge(self, alerts: DataFrame, batch: int) -> None:
        """Take in a micro-batch of alerts (bucket, kind, level, at). Of one bucket and kind the highest level and the latest time count."""
        now = alerts.agg(F.max("at").alias("now")).first().now
        if now is None:
            return
        new = alerts.groupBy("bucket", "kind").agg(F.max("level").alias("new"), F.max("at").alias("at"))
        days: Column = F.make_dt_interval(F.lit(self.stale))
        old = self.open(batch).withColumn("stale", F.col("last_updated") < F.lit(now).cast("timestamp_ntz") - days)
        self._write(old.where("stale").drop("stale").withColumn("expired_at", F.lit(now).cast("timestamp_ntz")), "closed", batch)
        both = old.where("not stale").drop("stale").join(new, ["bucket", "kind"], "full")
        known, told = F.col("alert_id").isNotNull(), F.col("at").isNotNull()
        raised = known & told & (F.col("new") > F.col("level"))
        sent = told & (~known | raised | (F.col("at") >= F.col("silent_until")))
        own = F.md5(F.concat_ws("|", "bucket", "kind", F.col("at").cast("string")).cast("binary"))  # all of it: parts of a hash meet by chance among many alerts
        both = both.select(
            F.coalesce("alert_id", own).alias("alert_id"), "bucket", "kind", F.coalesce("new", "level").alias("level"), F.coalesce("first_detected", "at").alias("first_detected"),
            F.coalesce("at", "last_updated").alias("last_updated"), (F.coalesce("weeks_persistent", F.lit(0)) + told.cast("int")).alias("weeks_persistent"),
            F.when(sent, F.col("at") + F.make_dt_interval(F.lit(self.hold))).otherwise(F.col("silent_until")).alias("silent_until"),
            (F.coalesce("n_sent", F.lit(0)) + sent.cast("int")).alias("n_sent"), F.col("level").alias("was"), told.alias("told"), raised.alias("raised"), known.alias("known"),
        )
        self._write(both, "merged", batch)
        merged = self.spark.read.schema(both.schema).parquet(f"{self.path}/merged/batch={batch}")
        self._write(merged.drop("was", "told", "raised", "known"), "open", batch)
        happened = F.array_compact(F.array(F.when(~F.col("known"), "created"), F.when(F.col("raised"), "severity_escalated"), F.when(F.col("known"), "updated")))
        log = merged.where("told").select("alert_id", "bucket", "kind", F.explode(happened).alias("event"), F.col("last_updated").alias("at"), F.col("was").alias("old"), F.col("level").alias("new"))
        gone = self.spark.read.schema(CLOSED).parquet(f"{self.path}/closed/batch={batch}")
        gone = gone.select("alert_id", "bucket", "kind", F.lit("expired").alias("event"), F.col("expired_at").alias("at"), F.col("level").alias("old"), F.lit(None).cast("int").alias("new"))
        self._write(log.unionByName(gone), "history", batch)
        self._forget(batch)

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def _forget(self, batch: int) -> None:
        """Versions that no delivery can need again: a batch starts only when the one before is committed."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        spare = {b: p for b, p in self._folders("open").items() if b < batch}
        for path in [p for b, p in spare.items() if b != max(spare)] + list(self._folders("merged").values()):
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def drain_into(store: AlertStore, alerts: DataFrame) -> None:
    """Run a stream of alerts over all that is there into a store, which has the stream's checkpoint beside it."""
    writer = alerts.writeStream.foreachBatch(lambda df, batch: AlertStore(df.sparkSession, store.path, store.stale, store.hold).merge(df, batch))
    writer.option("checkpointLocation", f"{store.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
