"""Structured Streaming: windows, sessions, first values, means, fan-out. State that ends by timers is in keyed.py."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: Hours for which an alert of a severity silences the same alert.
COOLDOWN_HOURS = {"low": 24, "medium": 48, "high": 72, "critical": 168}


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A finite table as a stream. All files come in one micro-batch, so that no watermark or state sees a part of the rows before earlier ones."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def drained(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote. Writes and checkpoint lie in the shared folder, so a restart goes on where it stopped."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def tumbling(df: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums of `value` in event-time windows; rows later than `late` are dropped, windows close with the watermark."""
    return df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).groupBy(F.window("_at", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def least(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row (keys, value) whenever the least value of a key falls, whatever the order of rows and micro-batches; the least of these rows is the key's. State is the least so far."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = ", ".join(f"{c} {kinds[c]}" for c in [*keys, value])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else None
        new = min((int(low) for pdf in batches if not pd.isna(low := pdf[value].min())), default=None)
        if new is not None and (was is None or new < was):
            state.update((new,))
            yield pd.DataFrame([[*key, new]], columns=[*keys, value])

    return df.groupBy(*keys).applyInPandasWithState(step, out, "least long", "append", "NoTimeout")


def smoothed(df: DataFrame, keys: list[str], at: str, value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean after each row of a key; state is the mean so far. Rows of a micro-batch are taken in order of time."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{at} {kinds[at]}", f"{value} {kinds[value]}", "ewma double"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(at)
        got = []
        for x in pdf[value]:
            mean = x if mean is None else alpha * x + (1 - alpha) * mean
            got.append(mean)
        state.update((float(mean),))
        yield pdf[[*keys, at, value]].assign(ewma=got)

    return df.groupBy(*keys).applyInPandasWithState(step, out, "mean double", "append", "NoTimeout")


#: Subscribers in one packed row.
PACK = 1000


def packed(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions (kind, target, subscriber, min_severity) as rows (kind, target, subscribers) of about PACK each."""
    order = F.create_map(*[x for k, s in enumerate(COOLDOWN_HOURS) for x in (F.lit(s), F.lit(k))])
    s = subscriptions.withColumn("least", F.coalesce(order[F.col("min_severity")], F.lit(0)))
    n = s.groupBy("kind", "target").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("subscriber"), F.ceil(F.col("_n") / PACK))
    s = s.join(n, ["kind", "target"]).withColumn("_p", part)
    return s.groupBy("kind", "target", "_p").agg(F.collect_list(F.struct("subscriber", "least")).alias("subscribers")).drop("_p")


def fan_out(messages: DataFrame, packs: DataFrame) -> DataFrame:
    """(message_id, subscriber) of messages (message_id, entity, category, severity), a stream or a table: by entity, by category or all.

    Each kind is an equi-join with packed() subscribers, so a target that many share is one row for each pack and message,
    filtered by the subscription's least severity and expanded last. A subscriber of several matching targets comes several times.
    """
    order = F.create_map(*[x for k, s in enumerate(COOLDOWN_HOURS) for x in (F.lit(s), F.lit(k))])
    level = F.coalesce(order[F.col("severity")], F.lit(0))
    target = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("target"))
    kinds = F.array(target("all", F.lit("")), target("entity", F.col("entity").cast("string")), target("category", F.col("category")))
    each = messages.select("message_id", level.alias("level"), F.explode(kinds).alias("t")).select("message_id", "level", "t.*")
    heard = F.filter("subscribers", lambda s: s["least"] <= F.col("level"))
    return each.join(packs, ["kind", "target"]).select("message_id", F.explode(heard).alias("s")).select("message_id", F.col("s.subscriber").alias("subscriber"))


def sessions(df: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after a gap, and their counts and sums of `value`; a session closes with the watermark."""
    marked = df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return marked.groupBy(*keys, F.session_window("_at", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
