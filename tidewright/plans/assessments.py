"""Queries that judge suppliers, orders and brands: reliability of sources, patterns of success, composite signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import composite as parts
from ..operators import assessment
from ..operators import timeseries as ts
from ..sources.tables import settled
from .registry import query


@query("""
WITH first_ship AS (SELECT l_orderkey, min(l_shipdate) AS first_at FROM lineitem GROUP BY 1),
c AS (
  SELECT l_suppkey AS source, o_orderpriority AS category, l_shipdate AS made, l_orderkey, l_returnflag = 'A' AS verified, l_returnflag = 'R' AS contradicted,
    l_shipdate = first_at AS earliest, date_diff('hour', first_at, l_shipdate)::DOUBLE AS delay
  FROM lineitem JOIN first_ship USING (l_orderkey) LEFT JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT source, category, count(*) AS n, count(*) FILTER (verified) AS v, count(*) FILTER (contradicted) AS x, count(*) FILTER (earliest) AS f, max(made) FILTER (verified) AS last FROM c GROUP BY ALL),
g AS (
  SELECT source, sum(n)::BIGINT AS n, sum(v)::BIGINT AS v, sum(x)::BIGINT AS x, sum(f)::BIGINT AS f, max(last) AS last,
    coalesce(sum((v / n::DOUBLE - 0.5) * 0.15) FILTER (category IN ('1-URGENT', '2-HIGH') AND n >= 3), 0) AS extra
  FROM k GROUP BY 1),
d AS (SELECT source, list_reduce(list(delay ORDER BY made, l_orderkey), lambda p, q: 0.3 * q + 0.7 * p) AS delay_hours FROM c GROUP BY 1),
b AS (SELECT s_suppkey AS source, CASE WHEN s_acctbal >= 7500 THEN 0.95 WHEN s_acctbal >= 5000 THEN 0.85 WHEN s_acctbal >= 2500 THEN 0.7 ELSE 0.5 END::DOUBLE AS base FROM supplier),
r AS (
  SELECT b.source, base, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(x, 0) AS x, coalesce(f, 0) AS f, delay_hours, date_diff('day', last::DATE, DATE '2001-12-01') AS days,
    base + (v / n::DOUBLE - 0.5) * 0.4 - 0.6 * x / n::DOUBLE + CASE WHEN v / n::DOUBLE > 0.5 THEN 0.1 * f / n::DOUBLE ELSE 0 END + extra AS raw
  FROM b LEFT JOIN g USING (source) LEFT JOIN d USING (source)),
q AS (SELECT *, CASE WHEN days > 30 THEN exp(-days / 90.0::DOUBLE) ELSE 1.0 END AS keep FROM r)
SELECT source, n AS claims, v AS verified, x AS contradicted, f AS first_reports, base, round(CASE WHEN n >= 5 THEN greatest(0.1, least(1.0, raw * keep + base * (1 - keep))) ELSE base END, 6) AS reliability,
  round(delay_hours, 4) AS delay_hours, n >= 5 AND coalesce(days > 30, false) AS faded FROM q""")
def source_reliability(t):
    """Suppliers as sources, each line a claim on its order: verified if accepted, contradicted if returned, first if no line of the order left earlier."""
    l = t("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag")
    first = l.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_at"))
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category"))
    c = l.join(first, "l_orderkey").join(o, "l_orderkey", "left")
    hours = F.datediff("l_shipdate", "first_at") * 24.0
    c = c.select(
        F.col("l_suppkey").alias("source"), "category", F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("tie"), (F.col("l_returnflag") == "A").alias("verified"),
        (F.col("l_returnflag") == "R").alias("contradicted"), (F.col("l_shipdate") == F.col("first_at")).alias("first"), hours.alias("delay"),
    )
    balance = F.col("s_acctbal")
    s = t("supplier").select(F.col("s_suppkey").alias("source"), F.when(balance >= 7500, 0.95).when(balance >= 5000, 0.85).when(balance >= 2500, 0.7).otherwise(0.5).alias("base"))
    got = assessment.reliability(settled(c, "claims"), s, "2001-12-01", ["1-URGENT", "2-HIGH"])
    return got.withColumns({"reliability": F.round("reliability", 6), "delay_hours": F.round("delay_hours", 4)})


REGIONS = {"west": ["america", "europe"], "east": ["asia", "middle"]}


@query("""
WITH s AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1),
f AS (
  SELECT o_orderpriority, c_mktsegment, lower(r_name) AS r, o_totalprice / 500000 AS p, o_totalprice > 250000 AS up, CASE WHEN (o_totalprice > 250000) = (o_orderstatus = 'F') THEN 1 ELSE 0 END AS hit,
    date_diff('day', o_orderdate::DATE, last::DATE) AS days
  FROM orders LEFT JOIN s ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey),
e AS (
  SELECT hit, 'mechanism' AS dimension, o_orderpriority AS pattern FROM f UNION ALL SELECT hit, 'category', c_mktsegment FROM f
  UNION ALL SELECT hit, 'entity_type', CASE WHEN r LIKE '%america%' OR r LIKE '%europe%' THEN 'west' WHEN r LIKE '%asia%' OR r LIKE '%middle%' THEN 'east' ELSE 'other' END FROM f
  UNION ALL SELECT hit, 'confidence', CASE WHEN p >= 0.9 THEN 'very_high' WHEN p >= 0.7 THEN 'high' WHEN p >= 0.5 THEN 'medium' WHEN p IS NOT NULL THEN 'low' END FROM f
  UNION ALL SELECT hit, 'direction', CASE WHEN up THEN 'up' ELSE 'down' END FROM f
  UNION ALL SELECT hit, 'timeframe', CASE WHEN days <= 7 THEN 'short_term' WHEN days <= 14 THEN 'medium_term' WHEN days IS NOT NULL THEN 'long_term' ELSE 'unknown' END FROM f),
g AS (SELECT dimension, coalesce(pattern, 'unknown') AS pattern, count(*) AS n, avg(hit) AS rate, CASE pattern WHEN 'very_high' THEN 0.9 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.5 ELSE 0 END::DOUBLE AS due FROM e GROUP BY ALL HAVING count(*) >= 2)
SELECT dimension, pattern, n, round(rate, 6) AS rate, round(n * abs(rate - 0.5), 4) AS weight, CASE WHEN n >= 10 THEN 'strong' WHEN n >= 5 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN dimension = 'confidence' THEN CASE WHEN rate < due - 0.15 THEN 'overconfident' WHEN rate > due + 0.15 THEN 'underconfident' ELSE 'calibrated' END
    WHEN rate >= 0.7 THEN 'reliable' WHEN rate >= 0.5 THEN 'moderate' WHEN rate >= 0.3 THEN 'weak' ELSE 'unreliable' END AS finding
FROM g""")
def success_patterns(t):
    """Orders as forecasts (dear ones finish), right or wrong by mechanism, category, kind of entity, confidence, direction and time to the last shipment."""
    last = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    f = t("orders").join(last, "o_orderkey", "left").join(c.join(n, "c_nationkey", "left"), "o_custkey", "left")
    price = F.col("o_totalprice")
    hit = F.coalesce((price > 250000) == (F.col("o_orderstatus") == "F"), F.lit(False))
    dimensions = {
        "mechanism": F.col("o_orderpriority"),
        "category": F.col("c_mktsegment"),
        "entity_type": assessment.by_rules(F.col("r_name"), REGIONS),
        "confidence": assessment.levels(price / 500000),
        "direction": F.when(price > 250000, "up").otherwise("down"),
        "timeframe": assessment.timeframes(F.datediff("last", "o_orderdate")),
    }
    got = assessment.success_patterns(f, hit, dimensions)
    return got.withColumns({"rate": F.round("rate", 6), "weight": F.round("weight", 4)})


MONTHS = """
m AS (
  SELECT p_brand AS brand, year(l_shipdate) * 12 + month(l_shipdate) AS month, count(*) AS n, round(avg(100 * (0.1 - l_discount)), 6) AS mood, round(sum(l_quantity * 100 * (0.1 - l_discount)) / sum(l_quantity), 6) AS heavy,
    round(avg(l_extendedprice / l_quantity), 4) AS price, round(sum(l_extendedprice), 2) AS total
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
x AS (
  SELECT *, row_number() OVER (PARTITION BY brand ORDER BY month DESC) - 1 AS back, mood - lag(mood) OVER (PARTITION BY brand ORDER BY month) AS step,
    round(avg(mood) OVER (PARTITION BY brand ORDER BY month ROWS 4 PRECEDING), 6) AS m5, round(avg(mood) OVER (PARTITION BY brand ORDER BY month ROWS 19 PRECEDING), 6) AS m20 FROM m)"""


def months(t):
    """A brand's months: lines, mood (0 to 10, by discount), mood weighted by quantity, price and turnover. Sums combine before the shuffle; from here on a brand has one row for each month."""
    l = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    mood, month = 100 * (0.1 - F.col("l_discount")), F.year("l_shipdate") * 12 + F.month("l_shipdate")
    heavy = F.try_divide(F.sum(F.col("l_quantity") * mood), F.sum("l_quantity"))
    return l.groupBy("brand", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(mood), 6).alias("mood"), F.round(heavy, 6).alias("heavy"),
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("price"), F.round(F.sum("l_extendedprice"), 2).alias("total"),
    )


@query(f"""
WITH {MONTHS},
s AS (
  SELECT brand, corr(mood, price) AS r, count(*) AS k, count(step) FILTER (back < 14) AS changes, avg(greatest(step, 0)) FILTER (back < 14) AS gain, avg(greatest(-step, 0)) FILTER (back < 14) AS loss,
    sum(n) FILTER (back < 3) AS n3, sum(n) FILTER (back BETWEEN 3 AND 5) AS n6, sum(total) FILTER (back < 6) AS t6, sum(total) FILTER (back BETWEEN 6 AND 11) AS t12,
    avg(heavy) FILTER (back < 12) AS heavy, avg(mood) FILTER (back < 12) AS plain, max(mood) FILTER (back = 0) AS mood, max(m5) FILTER (back = 0) AS m5, max(m20) FILTER (back = 0) AS m20, max(m5) FILTER (back = 1) AS p5, max(m20) FILTER (back = 1) AS p20,
    max(mood) FILTER (back = 3) AS mood3, max(price) FILTER (back = 0) AS price, max(price) FILTER (back = 3) AS price3
  FROM x GROUP BY 1),
l AS (SELECT a.brand, b.month - a.month AS lag, corr(a.mood, b.price) AS r FROM m a JOIN m b ON a.brand = b.brand AND b.month - a.month BETWEEN -3 AND 3 GROUP BY ALL HAVING count(*) >= 10),
b AS (SELECT brand, max_by(lag, (round(abs(r), 6), -lag)) AS lag, max_by(abs(r), (round(abs(r), 6), -lag)) AS power FROM l WHERE r IS NOT NULL GROUP BY 1),
y AS (
  SELECT *, abs(r) * sqrt((k - 2) / greatest(1 - r * r, 1e-12)) AS tv, 100 * (n3 - n6) / n6::DOUBLE AS momentum, t6 / t12 AS rate, avg(t6 / t12) OVER () AS sector,
    round(CASE WHEN changes < 14 THEN 50 WHEN loss < 1e-12 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 6) AS rsi, heavy - plain AS gap,
    CASE WHEN mood > m5 AND m5 > m20 THEN 'strong_bullish' WHEN m5 > m20 THEN 'bullish' WHEN mood < m5 AND m5 < m20 THEN 'strong_bearish' WHEN m5 < m20 THEN 'bearish' ELSE 'consolidating' END AS trend,
    (m5 > m20 AND p5 <= p20) IS TRUE AS golden, (m5 < m20 AND p5 >= p20) IS TRUE AS death,
    CASE WHEN mood > mood3 AND price < price3 THEN 'bullish' WHEN mood < mood3 AND price > price3 THEN 'bearish' WHEN mood3 IS NOT NULL THEN 'neutral' END AS kind, least(1.0, abs(mood - mood3) / 10) AS size
  FROM s LEFT JOIN b USING (brand)),
c AS (
  SELECT *, CASE WHEN tv > 2.576 THEN 'high' WHEN tv > 1.96 THEN 'medium' ELSE 'low' END AS level, CASE WHEN lag > 0 THEN power ELSE 0 END AS lead, rate / sector - 1 AS relative, rate >= 1.1 AS raising FROM y),
p AS (
  SELECT brand, unnest([
    {{'w': 0.2, 's': CASE WHEN level <> 'low' THEN (r + 1) * 50 END, 'c': CASE WHEN level = 'high' THEN 0.7 ELSE 0.5 END, 'u': r > 0.2, 'd': r < -0.2}},
    {{'w': 0.15, 's': CASE WHEN lead > 0.1 THEN lead * 100 END, 'c': least(lead + 0.3, 0.8), 'u': false, 'd': false}},
    {{'w': 0.15, 's': least(greatest(50 + momentum, 0), 100), 'c': 0.6, 'u': momentum > 20, 'd': momentum < -20}},
    {{'w': 0.15, 's': least(greatest(50 + 25 * relative, 0), 100), 'c': CASE WHEN raising THEN 0.7 ELSE 0.4 END, 'u': raising, 'd': false}},
    {{'w': 0.1, 's': rsi, 'c': abs(rsi - 50) / 50, 'u': rsi <= 30, 'd': rsi >= 70}},
    {{'w': 0.1, 's': CASE trend WHEN 'strong_bullish' THEN 90 WHEN 'bullish' THEN 70 WHEN 'consolidating' THEN 50 WHEN 'bearish' THEN 30 ELSE 10 END, 'c': CASE WHEN golden OR death THEN 0.7 ELSE 0.5 END, 'u': golden OR trend LIKE '%bullish', 'd': death OR trend LIKE '%bearish'}},
    {{'w': 0.1, 's': heavy * 10, 'c': 0.65, 'u': gap > 0.5, 'd': gap < -0.5}},
    {{'w': 0.05, 's': CASE kind WHEN 'bullish' THEN 70 + 30 * size WHEN 'bearish' THEN 30 - 30 * size WHEN 'neutral' THEN 50 END, 'c': size, 'u': kind = 'bullish', 'd': kind = 'bearish'}}], recursive := true) FROM c)
SELECT brand, round(sum(w * s)::DOUBLE / sum(w)::DOUBLE, 4) AS score, round(avg(c)::DOUBLE, 4) AS strength, CASE WHEN count(*) FILTER (u) > count(*) FILTER (d) + 1 THEN 'bullish' WHEN count(*) FILTER (d) > count(*) FILTER (u) + 1 THEN 'bearish' ELSE 'neutral' END AS direction, count(*)::INT AS parts
FROM p WHERE s IS NOT NULL GROUP BY 1""")
def composite_signals(t):
    """Eight weighted parts and their votes for each brand, from its months: mood with and ahead of price, lines, turnover against all brands, relative strength, means that cross, weight of volume, divergence."""
    k = ["brand"]
    m = settled(months(t), "months")
    w = ts.by(k, "month")
    x = m.withColumns({"m5": F.round(ts.sma("mood", k, "month", 5), 6), "m20": F.round(ts.sma("mood", k, "month", 20), 6), "step": F.col("mood") - F.lag("mood").over(w)})
    x = x.withColumn("back", F.row_number().over(Window.partitionBy(*k).orderBy(F.desc("month"))) - 1)
    back = F.col("back")
    during = lambda f, v, a, b: f(F.when(back.between(a, b), v))
    at = lambda v, a: during(F.max, F.col(v), a, a)
    s = x.groupBy(*k).agg(
        ts.pearson_of(F.col("mood"), F.col("price"), 2).alias("r"), F.count(F.lit(1)).alias("k"), during(F.count, F.col("step"), 0, 13).alias("changes"),
        during(F.avg, F.greatest("step", F.lit(0.0)), 0, 13).alias("gain"), during(F.avg, F.greatest(-F.col("step"), F.lit(0.0)), 0, 13).alias("loss"),
        during(F.sum, F.col("n"), 0, 2).alias("n3"), during(F.sum, F.col("n"), 3, 5).alias("n6"), during(F.sum, F.col("total"), 0, 5).alias("t6"), during(F.sum, F.col("total"), 6, 11).alias("t12"),
        during(F.avg, F.col("heavy"), 0, 11).alias("heavy"), during(F.avg, F.col("mood"), 0, 11).alias("plain"), at("mood", 0).alias("mood"), at("m5", 0).alias("m5"), at("m20", 0).alias("m20"),
        at("m5", 1).alias("p5"), at("m20", 1).alias("p20"), at("mood", 3).alias("mood3"), at("price", 0).alias("price"), at("price", 3).alias("price3"),
    )
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("month"))  # months as days, for lags
    ahead = ts.best_lag(ts.lead_lag(m.select(*k, day.alias("at"), F.col("mood").alias("v")), m.select(*k, day.alias("at"), F.col("price").alias("v")), k, "at", "v", range(-3, 4)), k)
    s = s.withColumn("rate", F.try_divide("t6", "t12")).join(ahead.select(*k, "lag", F.abs("r").alias("power")), k, "left")
    s = settled(s, "parts")
    s = s.join(F.broadcast(s.agg(F.avg("rate").alias("sector"))))  # one row
    c, both = F.col, lambda a, b: F.coalesce(a & b, F.lit(False))
    momentum = 100 * F.try_divide(c("n3") - c("n6"), c("n6").cast("double"))
    rsi = F.round(F.when(c("changes") < 14, 50.0).when(c("loss") < 1e-12, 100.0).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss"))), 6)
    rising, sinking = c("m5") > c("m20"), c("m5") < c("m20")
    trend = F.when((c("mood") > c("m5")) & rising, "strong_bullish").when(rising, "bullish").when((c("mood") < c("m5")) & sinking, "strong_bearish").when(sinking, "bearish").otherwise("consolidating")
    kind = F.when((c("mood") > c("mood3")) & (c("price") < c("price3")), "bullish").when((c("mood") < c("mood3")) & (c("price") > c("price3")), "bearish").when(c("mood3").isNotNull(), "neutral")
    out = parts.composite({
        "correlation": parts.correlation(c("r"), parts.significance(c("r"), c("k"))),
        "lead_lag": parts.lead_lag(F.when(c("lag") > 0, c("power")).otherwise(0.0)),
        "buzz": parts.buzz(momentum, F.when(momentum > 20, "accelerating").when(momentum < -20, "decelerating").otherwise("stable")),
        "funding": parts.funding(F.try_divide("rate", "sector") - 1, c("rate") >= 1.1),
        "rsi": parts.rsi(rsi),
        "trend": parts.trend(trend, both(rising, c("p5") <= c("p20")), both(sinking, c("p5") >= c("p20"))),
        "volume": parts.volume(c("heavy"), c("heavy") - c("plain")),
        "divergence": parts.divergence(kind, F.least(F.lit(1.0), F.abs(c("mood") - c("mood3")) / 10)),
    })
    return s.select("brand", F.round(out["score"], 4).alias("score"), F.round(out["strength"], 4).alias("strength"), out["direction"].alias("direction"), out["parts"].alias("parts"))
