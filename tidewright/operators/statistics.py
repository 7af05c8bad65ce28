"""Statistics, calibration and validation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import numbered


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share; null for n = 0."""
    m = F.when(n > 0, n.cast("double"))
    p, d = hits / m, 1 + z * z / m
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return (p + z * z / (2 * m) - half) / d, (p + z * z / (2 * m) + half) / d


def brier(p: Column, hit: Column) -> Column:
    return F.avg(F.pow(p - hit, F.lit(2.0)))


def equal_width(p: Column, n: int) -> Column:
    """Bin of a probability, 1 falling into the last."""
    return F.least(F.floor(p * n), F.lit(n - 1)).cast("int")


def edge_bin(p: Column, edges: list[float]) -> Column:
    """Bin between edges, closed below, the last one closed above too."""
    out = F.when(p < edges[1], 0)
    for k in range(1, len(edges) - 2):
        out = out.when(p < edges[k + 1], k)
    return out.otherwise(len(edges) - 2)


def reliability(df: DataFrame, p: str, hit: str, bins: int) -> DataFrame:
    """For each equal-width bin, empty ones too: n, mean forecast and share of hits."""
    got = df.groupBy(equal_width(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("forecast"), F.avg(hit).alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error over bins (n, forecast, observed)."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("forecast") - F.col("observed"))), F.sum("n")).alias("ece"))


def calibration_factor(n: Column, forecast: Column, observed: Column) -> Column:
    """Weighted mean of observed over forecast, held between 0.5 and 1.5."""
    ok = forecast > 0
    f = F.try_divide(F.sum(F.when(ok, n * observed / forecast)), F.sum(F.when(ok, n)))
    return F.least(F.greatest(F.coalesce(f, F.lit(1.0)), F.lit(0.5)), F.lit(1.5))


def walk_forward(df: DataFrame, order: list[str], n: int, train: float = 0.7, folds: int = 5) -> DataFrame:
    """Rows of each expanding fold: fold k is trained on what comes before its test rows. n is the number of rows."""
    first = int(n * train)
    step = max(1, (n - first) // folds)
    placed = numbered(df, order, "_place")
    placed = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = first + F.col("fold") * step
    return placed.where(F.col("_place") < start + step).withColumn("part", F.when(F.col("_place") < start, "train").otherwise("test")).drop("_place")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out / a


def t_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n pairs by Student's t; null for n < 3."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        def one(r, n):
            if pd.isna(r) or pd.isna(n) or n < 3:
                return None
            if abs(r) >= 1:
                return 0.0
            t2 = r * r * (n - 2) / (1 - r * r)
            return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))

        return pd.Series([one(r, n) for r, n in zip(rs, ns, strict=True)], dtype="float64")

    return p(r, n)


def fisher_interval(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Confidence interval of a correlation by Fisher's transform; null for n < 4 or |r| = 1."""
    ok = (n > 3) & (F.abs(r) < 1)
    f = F.when(ok, F.atanh(r))
    half = z / F.sqrt(F.when(ok, (n - 3).cast("double")))
    return F.tanh(f - half), F.tanh(f + half)


def mixed_bits(row: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """32 bits for each row and draw, by multiplications and shifts that any engine can repeat (fixed values)."""
    x = (row.astype(np.uint64)[:, None] * np.uint64(2654435761) + draw.astype(np.uint64)[None, :] * np.uint64(2246822519)) & np.uint64(0xFFFFFFFF)
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        x ^= x >> np.uint64(shift)
        x = (x * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


#: From which share of the draws on a row counts once, twice and so on: Poisson with mean 1.
POISSON_EDGES = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, row: str, draws: int = 1000) -> DataFrame:
    """2.5 and 97.5 percentiles of the mean under Poisson bootstrap: (keys, low, high).

    Each row enters each draw by a weight that its number `row` and the draw decide, so intervals do not depend on the
    partitions. A task adds up all draws of its rows in one matrix product for each key and sends `draws` sums of each;
    rows are never multiplied. Rows without a value do not count.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["draw int, w double, wx double"])
    every = np.arange(1, draws + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, g in pdf.groupby(keys, dropna=False, sort=False):
                w, wx = np.zeros(draws), np.zeros(draws)
                for at in range(0, len(g), 1000):
                    part = g.iloc[at : at + 1000]
                    weight = np.searchsorted(POISSON_EDGES, mixed_bits(part[row].to_numpy(), every) / 2.0**32, side="right")
                    w += weight.sum(axis=0)
                    wx += part[value].to_numpy(np.float64) @ weight
                yield pd.DataFrame({**dict(zip(keys, k, strict=True)), "draw": every.astype(np.int32), "w": w, "wx": wx})

    each = df.where(F.col(value).isNotNull()).select(*keys, value, row).mapInPandas(sums, schema)
    means = each.groupBy(*keys, "draw").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def bonferroni(p: Column, tests: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """p times the number of tests (1 at most), and whether it stays below alpha."""
    q = F.least(p * tests, F.lit(1.0))
    return q, q < alpha


def belief(df: DataFrame, key: str, strength: str, weight: str, prior: float, rate: float) -> DataFrame:
    """Prior plus rate times the weighted mean of signed evidence, between 0.05 and 0.95; without evidence the prior."""
    shift = F.coalesce(F.try_divide(F.sum(F.col(strength) * F.col(weight)), F.sum(weight)), F.lit(0.0))
    return df.groupBy(key).agg(F.least(F.greatest(prior + rate * shift, F.lit(0.05)), F.lit(0.95)).alias("belief"), F.count(F.lit(1)).alias("n"))


def normal_below(z: Column, terms: int = 100) -> Column:
    """The share of a normal distribution below z, by the series of odd powers over odd factorials; z counts up to 6 either way."""
    x = F.least(F.greatest(F.abs(z), F.lit(0.0)), F.lit(6.0))
    start = F.struct(x.alias("term"), x.alias("total"))
    grow = lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * x * x / (2 * k + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, grow, lambda s: s["total"])
    return 0.5 + F.signum(z) * total * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def by_parts(df: DataFrame, keys: list[str], value: str, part: Callable[[pd.Series], list[float]], width: int) -> DataFrame:
    """A statistic of one's own for each key: `part` turns any piece of a key's values into `width` numbers s0, s1, .., which are added up.

    Pieces are batches of tasks, so a key of any size is dealt over all of them and only sums are shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [f"s{k}" for k in range(width)]
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} double" for n in names])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [[*(k if isinstance(k, tuple) else (k,)), *map(float, part(g[value]))] for k, g in pdf.groupby(keys, dropna=False, sort=False)]
            yield pd.DataFrame(got, columns=[*keys, *names])

    return df.select(*keys, value).mapInPandas(pieces, schema).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def called_forward(folds: DataFrame, summary: list[Column], predict: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """The test rows of each fold (fold, part, ..) with a prediction of one's own.

    `summary` are aggregates of the fold's training rows; predict gets Arrow batches of test rows that carry them.
    """
    train = folds.where("part = 'train'").groupBy("fold").agg(*summary)  # a row for each fold
    test = folds.where("part = 'test'").join(train, "fold")
    return test.withColumn("prediction", F.pandas_udf(predict, "double")(F.struct(*[F.col(c) for c in test.columns])))
