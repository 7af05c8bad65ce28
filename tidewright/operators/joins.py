"""Joins and rows by key: latest, nearest in time, intervals, differences between snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled


def latest(df: DataFrame, keys: list[str], at: str, ties: bool = True) -> DataFrame:
    """Rows of the largest `at` of each key: with ties all of them, by a join with the maxima, so that no key is sorted in one task."""
    if not ties:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r")).select(*keys, "r.*")
    top = df.groupBy(*keys).agg(F.max(at).alias("_top"))
    return df.join(top, keys).where(F.col(at) == F.col("_top")).drop("_top")


def either_key(left: DataFrame, right: DataFrame, key: str, first: str, second: str, value: str) -> DataFrame:
    """value of right where key equals first, else where it equals second: two equi-joins instead of one with an or.

    Of several rows of right with one key, the least value counts; each row of left stays one row.
    """
    a = right.groupBy(F.col(first).alias("_a")).agg(F.min(value).alias("_va"))
    b = right.groupBy(F.col(second).alias("_b")).agg(F.min(value).alias("_vb"))
    out = left.join(a, left[key] == F.col("_a"), "left").join(b, left[key] == F.col("_b"), "left")
    return out.withColumn(value, F.coalesce("_va", "_vb")).drop("_a", "_va", "_b", "_vb")


def pairs_within(left: DataFrame, right: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """left and right rows of one key, right's time after left's by `days` at most (columns suffixed _l and _r).

    Times are cut into spans of `days`; a left row meets its own span and the next, so a key with many rows
    is dealt over its spans.
    """
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(days * 86_400_000_000)).cast("long")
    l = left.toDF(*[f"{c}_l" for c in left.columns]).withColumn("_s", F.explode(F.array(span(f"{at}_l"), span(f"{at}_l") + 1)))
    r = right.toDF(*[f"{c}_r" for c in right.columns]).withColumn("_t", span(f"{at}_r"))
    near = (F.col(f"{key}_l") == F.col(f"{key}_r")) & (F.col("_s") == F.col("_t"))
    gap = F.col(f"{at}_r") - F.col(f"{at}_l")
    return l.join(r, near).where((gap > F.expr("interval 0 days")) & (gap <= F.expr(f"interval {days} days"))).drop("_s", "_t")


def first_after(left: DataFrame, right: DataFrame, key: str, at: str, value: str, days: int) -> DataFrame:
    """Each left row with the first value of right at its own time or up to `days` later, and the days between, null if none.

    Times are cut into spans of `days`: a time meets the rows of its own span and the next, whatever the time of
    day. Of several rows of right at one time, the least value counts.
    """
    span = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(days * 86_400_000_000)).cast("long")
    spread = left.select(key, at).distinct().withColumn("_s", F.explode(F.array(span(F.col(at)), span(F.col(at)) + 1)))
    r = right.select(F.col(key).alias("_k"), F.col(at).alias("_r"), F.col(value).alias("_v")).withColumn("_t", span(F.col("_r")))
    met = spread.join(r, (spread[key] == r._k) & (F.col("_s") == F.col("_t"))).where((F.col("_r") >= F.col(at)) & (F.col("_r") <= F.col(at) + F.expr(f"interval {days} days")))
    found = met.groupBy(key, at).agg(F.min_by("_v", F.struct("_r", "_v")).alias(value), F.datediff(F.min("_r"), F.col(at)).alias("lag_days"))
    return left.join(found, [key, at], "left")


def value_before(df: DataFrame, keys: list[str], at: str, value: str, cutoff: Column, name: str) -> DataFrame:
    """For each key, the value nearest to but not after the cutoff."""
    return df.where(F.col(at) <= cutoff).groupBy(*keys).agg(F.max_by(value, at).alias(name))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """new, gone, stronger, weaker or same for each key of two snapshots; changes up to `least` are the same."""
    o, n = old.select(*keys, F.col(value).alias("old_value")), new.select(*keys, F.col(value).alias("new_value"))
    change = F.col("new_value") - F.col("old_value")
    kind = F.when(F.col("old_value").isNull(), "new").when(F.col("new_value").isNull(), "gone").when(change > least, "stronger").when(change < -least, "weaker").otherwise("same")
    return o.join(n, keys, "full").withColumn("change", kind)


def ladder(left: DataFrame, key: str, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first step that knows a key: each step is (name, DataFrame of key and target); adds target and matched_by."""
    out = left
    for k, (_, df) in enumerate(steps):
        out = out.join(df.groupBy(F.col(key).alias(f"_k{k}")).agg(F.min("target").alias(f"_t{k}")), F.col(key) == F.col(f"_k{k}"), "left")
    hit = [F.col(f"_t{k}").isNotNull() for k in range(len(steps))]
    by = reduce(lambda c, kv: c.when(hit[kv[0]], kv[1][0]), list(enumerate(steps))[1:], F.when(hit[0], steps[0][0]))
    return out.withColumn("target", F.coalesce(*[F.col(f"_t{k}") for k in range(len(steps))])).withColumn("matched_by", by).drop(*[f"_{c}{k}" for k in range(len(steps)) for c in "kt"])


def tiers(df: DataFrame, name: str, steps: list[tuple[str, str, DataFrame, float]], entities: DataFrame, deny: list[str], least: float, cap: float) -> DataFrame:
    """Adds target, tier and confidence: the first step (tier, column, DataFrame of column and target, confidence) that knows a row, then edit distance.

    Only the distinct names that no step knows meet the entities (name, target), in spans of log length, whatever
    their case. The best score from `least` on counts, `cap` at most; of several entities with it the name is
    ambiguous. Names in `deny` match nothing. A null name matches nothing.
    """
    out = df
    for k, (_, column, known, _) in enumerate(steps):
        out = out.join(known.groupBy(F.col(column).alias(f"_k{k}")).agg(F.min("target").alias(f"_t{k}")), F.col(column) == F.col(f"_k{k}"), "left")
    hit = [F.col(f"_t{k}").isNotNull() for k in range(len(steps))]
    none = reduce(lambda a, b: a & b, [~h for h in hit])
    denied = F.coalesce(F.col(name).isin(*deny), F.lit(False))
    step = F.log(F.lit(1 / least))
    span = F.floor(F.log(F.length("_q").cast("double")) / step).cast("int")
    rest = out.where(none & ~denied & (F.length(name) > 0)).select(F.col(name).alias("_q")).distinct().withColumn("_s", F.explode(F.array(span - 1, span, span + 1)))
    e = entities.select(F.col("name").alias("_q"), F.col("target").alias("_e")).where(F.length("_q") > 0).select(F.col("_q").alias("_n"), "_e", span.alias("_s"))
    score = 1 - F.levenshtein(F.lower("_q"), F.lower("_n")) / F.greatest(F.length("_q"), F.length("_n"))
    near = rest.join(e, "_s").select("_q", "_e", F.round(score, 6).alias("_score")).where(F.col("_score") >= least)
    best = near.groupBy("_q", "_score").agg(F.count_distinct("_e").alias("_c"), F.min("_e").alias("_e")).groupBy("_q").agg(F.max_by(F.struct("_score", "_c", "_e"), "_score").alias("_b"))
    out = out.join(best, F.col(name) == F.col("_q"), "left")
    one, many = F.col("_b._c") == 1, F.col("_b._c") > 1
    tier, sure = F.when(denied, "denied"), F.when(denied, 0.0)
    for k, (label, _, _, c) in enumerate(steps):
        tier, sure = tier.when(hit[k], label), sure.when(hit[k], c)
    known = F.coalesce(*[F.col(f"_t{k}") for k in range(len(steps))])
    target = F.when(~denied, F.coalesce(known, F.when(one, F.col("_b._e"))))
    tier = tier.when(one, "fuzzy").when(many, "ambiguous").otherwise("none")
    sure = sure.when(one, F.least(F.col("_b._score"), F.lit(cap))).otherwise(0.0)
    return out.withColumn("target", target).withColumn("tier", tier).withColumn("confidence", sure).drop(*[f"_{c}{k}" for k in range(len(steps)) for c in "kt"], "_q", "_b")


def replay(feeds: DataFrame, key: str, day: str, signals: str, back: int) -> DataFrame:
    """Each day from the first feed to the last: keys with a feed of the day (fresh), with one of up to `back` days before (fallback) or with none (skipped), and the signals that came in.

    A feed (one row for a key and day) serves the days up to `back` after its own, of which each key takes the newest; no key is sorted.
    """
    ends = feeds.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))  # one row
    served = feeds.select(key, signals, F.col(day).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_d")).withColumn(day, F.date_add("_own", F.col("_d")))
    used = served.groupBy(key, day).agg(F.min("_d").alias("_d"), F.min_by(signals, "_d").alias("_n"))
    per = used.groupBy(day).agg(F.count_if(F.col("_d") == 0).alias("fresh"), F.count_if(F.col("_d") > 0).alias("fallback"), F.sum("_n").alias("_n"))
    days = ends.select(F.explode(F.sequence("_a", "_b")).alias(day))
    keys = feeds.agg(F.count_distinct(key).alias("_keys"))  # one row
    out = days.join(per, day, "left").join(F.broadcast(keys)).fillna(0, ["fresh", "fallback", "_n"])
    return out.select(day, "fresh", "fallback", (F.col("_keys") - F.col("fresh") - F.col("fallback")).alias("skipped"), F.col("_n").cast("long").alias("signals"))


def islands(df: DataFrame, keys: list[str], order: str, good: Column, name: str) -> DataFrame:
    """Adds the number of rows in a row, up to this one, for which `good` holds; it starts anew after each that fails."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = df.withColumn("_g", F.coalesce(good, F.lit(False))).withColumn("_i", F.sum((~F.col("_g")).cast("int")).over(w))
    return runs.withColumn(name, F.sum(F.col("_g").cast("int")).over(Window.partitionBy(*keys, "_i").orderBy(order))).drop("_g", "_i")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 0: ranges are sorted apart, and offsets come from their counts."""
    own = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))  # a row for each range
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(offsets, "_p").withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_p", "_o", "_r")
