"""Ordered analytics over long series (keys, at, value). A key's series is daily or weekly, hence of bounded length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled
from .joins import numbered


def by(keys: list[str], at: str):
    return Window.partitionBy(*keys).orderBy(at)


def last_rows(keys: list[str], at: str, n: int, before: int = 0):
    """The n rows that end `before` rows ahead of the current one."""
    return by(keys, at).rowsBetween(-(n - 1) - before, -before)


def daily(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last value of each day, days without one taking the value before: (keys, day, value, filled)."""
    last = df.groupBy(*keys, F.to_date(at).alias("day")).agg(F.max_by(value, at).alias(value))
    span = last.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    all_ = days.join(last, [*keys, "day"], "left")
    upto = by(keys, "day").rowsBetween(Window.unboundedPreceding, 0)
    return all_.select(*keys, "day", F.last(value, ignorenulls=True).over(upto).alias(value), F.col(value).isNull().alias("filled"))


def pearson(x: str, y: str, w, least: int) -> Column:
    """Correlation over a window; null for fewer than `least` pairs or no variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n = F.count(a).over(w)
    va, vb = F.var_pop(a).over(w), F.var_pop(b).over(w)
    return F.when((n >= least) & (va > 1e-12) & (vb > 1e-12), F.try_divide(F.covar_pop(a, b).over(w), F.sqrt(va) * F.sqrt(vb)))


def pearson_of(x: Column, y: Column, least: int) -> Column:
    """The same as a group aggregate."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.count(a) >= least) & (F.var_pop(a) > 1e-12) & (F.var_pop(b) > 1e-12), F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))))


def lead_lag(a: DataFrame, b: DataFrame, keys: list[str], day: str, value: str, lags: range, least: int = 10) -> DataFrame:
    """(keys, lag, r, n): correlation of a's value with b's `lag` days later. Each row of a meets one row of b for each lag."""
    left = a.select(*keys, F.col(day).alias("_d"), F.col(value).alias("_x")).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    left = left.withColumn(day, F.date_add("_d", F.col("lag")))
    both = left.join(b.select(*keys, day, F.col(value).alias("_y")), [*keys, day])
    return both.groupBy(*keys, "lag").agg(pearson_of(F.col("_x"), F.col("_y"), least).alias("r"), F.count(F.lit(1)).alias("n")).where("r is not null")


def best_lag(scan: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of the largest absolute correlation of each key (six digits), the first of equal ones."""
    order = F.struct(F.round(F.abs("r"), 6).alias("a"), (-F.col("lag")).alias("l"))
    return scan.groupBy(*keys).agg(F.max_by(F.struct("lag", "r", "n"), order).alias("b")).select(*keys, "b.*")


def sma(value: str, keys: list[str], at: str, n: int) -> Column:
    return F.avg(value).over(last_rows(keys, at, n))


def roc(value: str, keys: list[str], at: str, n: int) -> Column:
    """Change in percent against n rows before."""
    old = F.lag(value, n).over(by(keys, at))
    return F.when(F.abs(old) > 1e-12, 100 * (F.col(value) - old) / F.abs(old))


def acceleration(value: str, keys: list[str], at: str, n: int) -> Column:
    """Difference of two n-step changes that follow each other."""
    w = by(keys, at)
    return (F.col(value) - F.lag(value, n).over(w)) - (F.lag(value, n).over(w) - F.lag(value, 2 * n).over(w))


def rsi(value: str, keys: list[str], at: str, n: int = 14) -> DataFrame:
    """Relative strength by simple means of the last n changes: 50 if there are fewer, 100 without losses."""

    def add(df: DataFrame, name: str = "rsi") -> DataFrame:
        w = last_rows(keys, at, n)
        d = df.withColumn("_c", F.col(value) - F.lag(value).over(by(keys, at)))
        up, down = F.avg(F.greatest("_c", F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("_c"), F.lit(0.0))).over(w)
        d = d.withColumn("_n", F.count("_c").over(w)).withColumn("_u", up).withColumn("_v", down)
        return d.withColumn(name, F.when(F.col("_n") < n, 50.0).when(F.col("_v") < 1e-12, 100.0).otherwise(100 - 100 / (1 + F.col("_u") / F.when(F.col("_v") >= 1e-12, F.col("_v"))))).drop("_c", "_n", "_u", "_v")

    return add


def bollinger(df: DataFrame, value: str, keys: list[str], at: str, n: int = 20, k: float = 2.0) -> DataFrame:
    """Mid, upper, lower and the place between them (null for fewer than n rows or no spread)."""
    w = last_rows(keys, at, n)
    full = F.count(value).over(w) >= n
    mid, sd = F.when(full, F.avg(value).over(w)), F.when(full, F.stddev_samp(value).over(w))
    d = df.withColumn("mid", mid).withColumn("_s", sd)
    d = d.withColumn("upper", F.col("mid") + k * F.col("_s")).withColumn("lower", F.col("mid") - k * F.col("_s"))
    return d.withColumn("place", F.try_divide(F.col(value) - F.col("lower"), F.when(F.col("_s") > 1e-9, F.col("upper") - F.col("lower")))).drop("_s")


def placed(df: DataFrame, keys: list[str], order: str, out: str = "_i") -> DataFrame:
    """Adds the place of each row among its key's, from 0. Ranges of (keys, order) are numbered apart, so a key of any length is dealt over tasks."""
    all_ = numbered(df, [*keys, order], "_all")
    first = all_.groupBy(*keys).agg(F.min("_all").alias("_first"))
    return settled(all_.join(first, keys).withColumn(out, F.col("_all") - F.col("_first")).drop("_all", "_first"), "placed")


def ema(df: DataFrame, keys: list[str], value: str, alpha: float, out: str, seed: int = 1, place: str = "_i") -> DataFrame:
    """Adds `out` to placed() rows: alpha * value + (1 - alpha) * the one before, from the mean of the first `seed` values on; null before that.

    Each step is an affine map, and so is a block of steps. Blocks are so long that a block's factor is below 1e-20: what
    comes into a block is then the sum of the few blocks before it, each with its power of the factor. Inside a block a
    running sum of scaled values does the rest. No key's series is held by a task.
    """
    d = 1 - alpha
    size = max(1, math.ceil(46 / -math.log(d))) if 0 < d < 1 else 1 << 40
    start = df.where(F.col(place) < seed).groupBy(*keys).agg(F.avg(value).alias("_seed"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == seed).drop("_n")
    j = F.col(place) - (seed - 1)
    y = F.when(j == 0, F.col("_seed")).otherwise(alpha * F.col(value))
    run = df.join(start, keys).where(j >= 0).withColumn("_b", F.floor(j / size)).withColumn("_r", (j % size).cast("double"))
    inside = F.sum(y * F.pow(F.lit(1 / d if d > 0 else 0.0), F.col("_r"))).over(Window.partitionBy(*keys, "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    run = settled(run.withColumn("_in", (inside * F.pow(F.lit(d), F.col("_r"))) if d > 0 else y), "scan")
    blocks = run.groupBy(*keys, "_b").agg(F.max_by("_in", "_r").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_b")
    came = sum((F.coalesce(F.lag("_s", k).over(w), F.lit(0.0)) * (d ** (size * (k - 1))) for k in range(2, 5)), F.coalesce(F.lag("_s", 1).over(w), F.lit(0.0)))
    blocks = blocks.select(*keys, "_b", came.alias("_c"))
    done = run.join(blocks, [*keys, "_b"]).withColumn(out, F.col("_in") + F.pow(F.lit(d), F.col("_r") + 1) * F.col("_c"))
    early = df.join(start, keys, "left_anti").unionByName(df.join(start.select(*keys), keys, "left_semi").where(j < 0)).withColumn(out, F.lit(None).cast("double"))
    return settled(done.select(*df.columns, out).unionByName(early.select(*df.columns, out)), "ema")


def last_ema(df: DataFrame, keys: list[str], value: str, alpha: float, out: str, place: str = "_i") -> DataFrame:
    """(keys, out): where ema() of each key's placed() rows ends. Each row's part depends on its place from the end alone, so the sum combines before the shuffle."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col(place) == 0, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("_n") - 1 - F.col(place))
    return df.join(n, keys).groupBy(*keys).agg(F.sum(F.col(value) * share).alias(out))


def clipped(df: DataFrame, keys: list[str], value: str, low: float, high: float, out: str) -> DataFrame:
    """Adds `out`: the value held between its key's sorted values at int(n * low) and int(n * high)."""
    r = placed(df, keys, value, "_rank")
    n = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, keys)
    at = lambda share: F.max(F.when(F.col("_rank") == F.least(F.floor(F.col("_n") * share), F.col("_n") - 1), F.col(value)))
    edges = r.groupBy(*keys).agg(at(low).alias("_lo"), at(high).alias("_hi"))
    return r.join(edges, keys).withColumn(out, F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))).drop("_rank", "_n", "_lo", "_hi")


def baseline(df: DataFrame, keys: list[str], at: str, value: str, n: int) -> DataFrame:
    """Mean, deviation, median, 10th and 90th value by index, and slope of the last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    recent = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    s = F.array_sort(F.collect_list(value))
    d = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median"), s.alias("_s"), F.regr_slope(F.col(value), -F.col("_r")).alias("slope"), F.max_by(value, at).alias("latest"))
    d = d.withColumn("p10", F.get("_s", F.floor(F.col("n") * 0.1).cast("int"))).withColumn("p90", F.get("_s", F.floor(F.col("n") * 0.9).cast("int"))).drop("_s")
    return d.withColumn("z", F.try_divide(F.col("latest") - F.col("mean"), F.when(F.col("sd") > 1e-9, F.col("sd"))))


def percent_below(value: str, keys: list[str]) -> Column:
    """Share in percent of the group's rows that are strictly below, one digit."""
    w = Window.partitionBy(*keys)
    return F.round(100 * (F.rank().over(w.orderBy(value)) - 1) / F.count(F.lit(1)).over(w), 1)
