"""Keyed state that ends: histories, retention and life cycles under event time.

Input comes a day (or any period) at a time, as one micro-batch each. State is held in typed variables of a keyed
processor; event-time timers emit what happens without news and then remove the key's state, so that the store holds
only keys that are alive. Rows of a key are put in order within their micro-batch, which has at most a period of them.
A processor works on packs of keys, some thousand at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.tables import shared_folder

DAY_MS = 86_400_000
#: The state store that typed state and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Column by which dated() tells periods apart.
PERIOD = "period"
#: Age of the first period's file.
FIRST_MS = 1_000_000_000_000


def arrive(df: DataFrame, period: Column, path: str | None = None) -> str:
    """Write rows as files that a stream will read a period at a time, in ascending order (null first); returns the folder.

    Each period is one file in a folder of its own; a period's rows are pre-aggregated by the caller where they are many.
    Given an earlier folder, later periods are added to it. The file source takes files by age, so their times are set in
    order of periods: a call for each period, none for rows.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    df.withColumn(PERIOD, F.coalesce(period.cast("string"), F.lit(""))).repartition(PERIOD).write.mode("append").partitionBy(PERIOD).parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for k, folder in enumerate(sorted((s.getPath() for s in fs.listStatus(root) if s.isDirectory()), key=lambda p: p.getName())):
        for s in fs.listStatus(folder):
            fs.setTimes(s.getPath(), FIRST_MS + 1000 * k, -1)
    return path


def arrivals(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of what arrive() wrote, one micro-batch for each period."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{PERIOD}=*")


def dated(df: DataFrame, period: Column) -> DataFrame:
    """df as a stream of one micro-batch for each value of `period`."""
    return arrivals(df.sparkSession, arrive(df, period), df.schema)


def run(df: DataFrame, label: str, path: str | None = None) -> tuple[DataFrame, str]:
    """Run a keyed stream over all that is there: what it wrote, and its folder. Given the folder of an earlier run, it goes on from there."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(df.schema).parquet(f"{path}/out"), path


def held(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """What the state store of run() holds now under a variable's name."""
    return spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", variable).load()


def _us(at: pd.Series) -> np.ndarray:
    """Microseconds of times without zone, read as UTC."""
    return at.to_numpy().astype("datetime64[us]").astype(np.int64)


def _in_order(rows: Iterator[pd.DataFrame], at: str, *more: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values([at, *more], kind="stable", ignore_index=True)


class _Keyed(StatefulProcessor):
    """A processor of all keys of a group at once: the group is one key, or a pack of them (see keyed()).

    The group's state is one value, a table in Arrow's format with the state rows of its keys, and one timer: the time at
    which a key of it is next looked at without news. So what a micro-batch costs follows its rows and the rows of state,
    and not calls for each key. A processor has `step(old, news, upto)`: state rows and rows of input (in order; either may
    be None) to the state rows after, the time in ms to wake at for each key of them, and the output. Keys whose time is
    `upto` or before are done with in the step.
    """

    variable = "state"
    order: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState(self.variable, "rows binary")

    def step(self, old: pd.DataFrame | None, news: pd.DataFrame | None, upto: int) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self.visit(_in_order(rows, *self.order), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.visit(None, timerValues)

    def visit(self, news: pd.DataFrame | None, timerValues) -> Iterator[pd.DataFrame]:
        was = self.held.get()
        old = pa.ipc.open_stream(was[0]).read_pandas() if was else None
        if old is not None or news is not None:
            state, wakes, out = self.step(old, news, timerValues.getCurrentWatermarkInMs())
            if len(state):
                sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(state, preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                self.held.update((sink.getvalue().to_pybytes(),))
            else:
                self.held.clear()
            self.wake(int(wakes.min()) if len(state) else None)
            if out is not None and len(out):
                yield out

    def wake(self, at_ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            if t != at_ms:
                self.handle.deleteTimer(t)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def by_key(self, old: pd.DataFrame | None, news: pd.DataFrame | None) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of state and of input, a key's together, its state first: the rows, which are news, and the first and last place of each row's key."""
        given = [(x, k) for k, x in enumerate((old, news)) if x is not None]
        both = pd.concat([x for x, _ in given], ignore_index=True)
        new = np.concatenate([np.full(len(x), k, bool) for x, k in given])
        code = both.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        both, new, code = both.take(order).reset_index(drop=True), new[order], code[order]
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        counts = np.diff(np.append(begins, len(code)))
        return both, new, np.repeat(begins, counts), np.repeat(begins + counts - 1, counts)

    def close(self) -> None:
        pass


class History(_Keyed):
    """The last `most` points of a key, smoothed: clipped to their own `clip` quantiles, then an exponentially weighted mean.

    Fewer points than `least` are passed on as they are. Rows (key.., id, at, value) give (key.., id, n_history, smoothed,
    noise_reduction): how much less the smoothed history spreads than the raw one. A key without rows for `days` days
    after its last one loses its history.
    """

    variable, order = "points", ("at", "id")
    #: Windows that are smoothed side by side.
    ROWS = 4096

    def __init__(self, keys: list[str], alpha: float, most: int = 52, least: int = 3, clip: tuple[float, float] = (0.05, 0.95), days: int = 60) -> None:
        self.keys, self.alpha, self.most, self.least, self.clip, self.days = keys, alpha, most, least, clip, days

    def smoothed(self, values: list[float]) -> list[float]:
        x = np.array([values], float)
        return self.smooth(x, np.full(1, x.shape[1]))[0].tolist()

    def smooth(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Smoothed windows: a row's last n values are its window."""
        rows, width = np.arange(len(x)), x.shape[1]
        s = np.sort(np.where(np.arange(width) >= width - n[:, None], x, np.inf), axis=1)
        low, high = s[rows, (n * self.clip[0]).astype(int)], s[rows, np.minimum((n * self.clip[1]).astype(int), n - 1)]
        out = np.minimum(np.maximum(x, low[:, None]), high[:, None])
        for k in range(1, width):
            out[:, k] = np.where(k > width - n, self.alpha * out[:, k] + (1 - self.alpha) * out[:, k - 1], out[:, k])
        return out

    def step(self, old, news, upto):
        # state rows have no id: it stays in a column of its own kind, so that no id passes through a float
        ids = None if news is None else news["id"]
        if news is not None:
            news = news[[*self.keys]].assign(at=_us(news["at"]) // 1000, value=news["value"].astype(float), row=np.arange(len(news)))
        both, new, first, last = self.by_key(old if old is None else old.assign(row=-1), news)
        ms, value, place = both["at"].to_numpy(), both["value"].to_numpy(), np.arange(len(both))
        fresh = (first == place) | (np.diff(ms, prepend=ms[:1]) >= self.days * DAY_MS)
        begin = np.maximum.accumulate(np.where(fresh, place, 0))
        out = None
        if news is not None:
            at = np.flatnonzero(new)
            n = np.minimum(at - begin[at] + 1, self.most)
            smooth, less = value[at].copy(), np.zeros(len(at))
            enough = np.flatnonzero(n >= self.least)
            for k in range(0, len(enough), self.ROWS):
                own = enough[k : k + self.ROWS]
                m = n[own]
                width = int(m.max())
                inside = np.arange(width) >= width - m[:, None]
                x = value[np.where(inside, at[own][:, None] - np.arange(width - 1, -1, -1), at[own][:, None])]
                y = self.smooth(x, m)
                smooth[own] = y[:, -1]
                spread = self.deviation(x, inside, m)
                less[own] = np.where(spread > 0, 1 - self.deviation(y, inside, m) / np.where(spread > 0, spread, 1), 0.0)
            out = both.loc[at, self.keys].assign(id=ids.to_numpy()[both["row"].to_numpy()[at]], n_history=n, smoothed=smooth, noise_reduction=less)
        keep = (place > last - self.most) & (place >= begin[last])
        wakes = ms[last] + self.days * DAY_MS
        keep &= wakes > upto
        return both.loc[keep, [*self.keys, "at", "value"]], wakes[keep], out

    @staticmethod
    def deviation(x: np.ndarray, inside: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations of windows; exactly 0 where all values are equal."""
        mean = np.where(inside, x, 0.0).sum(axis=1) / n
        d = np.where(inside, x - mean[:, None], 0.0)
        flat = np.where(inside, x, x[:, -1:]).max(axis=1) == np.where(inside, x, x[:, -1:]).min(axis=1)
        return np.where(flat, 0.0, np.sqrt((d * d).sum(axis=1) / np.maximum(n - 1, 1)))


class Retention(_Keyed):
    """Rows (key.., day, n) of the last `days` days: (key.., day, n_kept, n_days) for each day with news, its own included.

    A key whose last day is `days` days past gives a row for that time with n_kept 0, and its state is gone.
    """

    variable, order = "kept", ("day",)

    def __init__(self, keys: list[str], days: int = 60) -> None:
        self.keys, self.days = keys, days

    def step(self, old, news, upto):
        if news is not None:
            news = news[[*self.keys]].assign(day=_us(news["day"]) // 1000 // DAY_MS, n=news["n"].to_numpy())
        both, new, first, last = self.by_key(old, news)
        day, n, place = both["day"].to_numpy(), both["n"].to_numpy(), np.arange(len(both))
        # one ascending line of all keys' days, a key's days lying more than `days` after those of the key before
        line = day - day.min() + first * (int(day.max() - day.min()) + self.days + 1)
        begin = np.searchsorted(line, line - self.days, side="right")
        upon = np.append(0, np.cumsum(n))
        at = np.flatnonzero(new)
        got = [both.loc[at, self.keys].assign(day_number=day[at], n_kept=upon[at + 1] - upon[begin[at]], n_days=at - begin[at] + 1)]
        gap = np.append(np.diff(day), 0)  # to the key's next day
        gone = np.flatnonzero((place < last) & (gap > self.days) | (place == last) & ((day + self.days) * DAY_MS <= upto))
        got.append(both.loc[gone, self.keys].assign(day_number=day[gone] + self.days, n_kept=0, n_days=0))
        wakes = (day[last] + self.days) * DAY_MS
        keep = (day > day[last] - self.days) & (wakes > upto)
        return both.loc[keep, [*self.keys, "day", "n"]], wakes[keep], pd.concat(got)


class Silence(_Keyed):
    """Rows (key.., id, at, hours) that no earlier row of their key silences: a row that passes holds the key for its `hours`.

    Gives (key.., id). The key's state is one time, and is gone once that is past.
    """

    variable, order = "until", ("at", "id")

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def step(self, old, news, upto):
        ids = None if news is None else news["id"].to_numpy()
        if news is not None:
            news = news[[*self.keys]].assign(us=_us(news["at"]), hold=news["hours"].to_numpy(np.int64) * 3_600_000_000, row=np.arange(len(news)))
        both, new, first, last = self.by_key(old if old is None else old.assign(hold=0, row=-1), news)
        ends, passed, until = both["us"].to_numpy().copy(), [], 0
        for k, (is_new, begins, us, hold) in enumerate(zip(new.tolist(), (first == np.arange(len(both))).tolist(), both["us"].tolist(), both["hold"].tolist(), strict=True)):
            if is_new and (begins or us >= until):
                passed.append(k)
                until = us + hold
            elif begins:
                until = us
            ends[k] = until
        out = None if news is None else both.loc[passed, self.keys].assign(id=ids[both["row"].to_numpy()[passed]])
        wakes = ends // 1000 + 1
        keep = (last == np.arange(len(both))) & (wakes > upto)
        return both.loc[keep, self.keys].assign(us=ends[keep]), wakes[keep], out


#: States of a signal, and days without news after which it fades and dies.
STATES = ("weak", "emerging", "trending", "mainstream", "fading", "dead")
FADE_DAYS, DEAD_DAYS = 7, 30


class Lifecycle(_Keyed):
    """(key.., day, level) to (key.., day, status): two strong days in a row lift a signal one step, days without news lower it.

    A day is strong if its level is at least twice the last step's (2, 4, 8). A signal that has not been seen for
    FADE_DAYS fades on that day; one not seen for DEAD_DAYS dies on that day and is forgotten. A fading signal that is
    seen again is weak. The rows of fading and dying come from timers, or from the next news if that comes first.
    """

    variable, order = "now", ("day",)

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def quiet(self, status: str, last: int, upto: int) -> Iterator[tuple[int, str]]:
        """What happens without news after day `last`, up to and including a day."""
        if status != "fading" and last + FADE_DAYS <= upto:
            yield last + FADE_DAYS, "fading"
        if last + DEAD_DAYS <= upto:
            yield last + DEAD_DAYS, "dead"

    def step(self, old, news, upto):
        if news is not None:
            news = news[[*self.keys]].assign(day=_us(news["day"]) // 1000 // DAY_MS, level=news["level"].to_numpy(float), status="", strong=0)
        both, new, first, last = self.by_key(old if old is None else old.assign(level=0.0), news)
        place, got, held = np.arange(len(both)), [], []
        status, strong, was = None, 0, 0
        rows = zip(new.tolist(), (first == place).tolist(), (last == place).tolist(), *(both[c].tolist() for c in ("day", "level", "status", "strong")), strict=True)
        for k, (is_new, begins, ends, day, level, old_status, old_strong) in enumerate(rows):
            if begins:
                status, strong, was = None, 0, 0
            if is_new:
                for d, status in self.quiet(status, was, day - 1) if status else ():
                    got.append((k, d, status))
                if status in (None, "fading", "dead"):
                    status, strong = "weak", int(level >= 2) if status in (None, "dead") else 0
                else:
                    j = STATES.index(status)
                    strong = strong + 1 if level >= 2 ** (j + 1) else 0
                    if strong >= 2 and j < 3:
                        status, strong = STATES[j + 1], 0
                got.append((k, day, status))
            else:
                status, strong = old_status, old_strong
            was = day
            if ends:
                for d, now in self.quiet(status, was, upto // DAY_MS):
                    got.append((k, d, now))
                    status, strong = now, 0
                if status != "dead":
                    held.append((k, status, strong, was))
        at, days, states = zip(*got) if got else ((), (), ())
        out = both.loc[list(at), self.keys].assign(day_number=days, status=states)
        at, status, strong, day = zip(*held) if held else ((), (), (), ())
        state = both.loc[list(at), self.keys].assign(day=np.array(day, np.int64), status=list(status), strong=np.array(strong, np.int64))
        return state, (state["day"].to_numpy() + np.where(state["status"].to_numpy() == "fading", DEAD_DAYS, FADE_DAYS)) * DAY_MS, out


#: Keys in a pack, about, and packs at least.
PACK, PACKS = 4096, 64


def packs_of(df: DataFrame, keys: list[str]) -> int:
    """How many packs the keys of a table want. A stream that goes on from an earlier state must keep its number."""
    return max(PACKS, -(-df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] // PACK))


def keyed(df: DataFrame, keys: list[str], at: str, processor: StatefulProcessor, schema: str, late: str = "0 seconds", packs: int | None = None) -> DataFrame:
    """Apply a processor to a stream by key, or by packs of keys; timers follow the watermark of `at`, rows later than `late` are dropped.

    A pack is a group of keys by their hash (rows without a key are one of their own), whose state and timer are one: Python
    is called, and state is read and written, for each pack of a micro-batch and not for each key.
    """
    marked = df.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    if packs is None:
        return marked.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    none = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    marked = marked.withColumn("_pack", F.when(none, -1).otherwise(F.pmod(F.xxhash64(*keys), F.lit(packs)).cast("int")))
    return marked.groupBy("_pack").transformWithStateInPandas(processor, schema, "Append", "EventTime")
