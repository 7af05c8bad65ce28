"""Scoring and alert queries. Categories are event types: click technical, view media, purchase financial, signup product, error company."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from .registry import query

KINDS = {"technical": "click", "media": "view", "financial": "purchase", "product": "signup", "company": "error"}
PROFILE = "p AS (SELECT user_id, " + ", ".join(f"least(100.0, round(avg(value) FILTER (event_type = '{k}'), 6)) AS {n}" for n, k in KINDS.items()) + ", count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1)"


def profiles(t):
    return t("events").groupBy("user_id").agg(*[F.least(F.lit(100.0), F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 6)).alias(n) for n, k in KINDS.items()], F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))


@query(f"""WITH {PROFILE} SELECT user_id, round(least(100 * log10(n + 1) / log10(1001), 100.0), 5) AS volume, CASE WHEN technical <= 20 THEN 10.0 WHEN technical <= 50 THEN 40.0 WHEN technical <= 80 THEN 70.0 ELSE 95.0 END AS bracket,
round(10 * pow(1 / (1 + exp(-(technical / 10 - 5))), 1.12), 5) AS gravity FROM p WHERE technical IS NOT NULL""")
def scales(t):
    """Logarithmic, bracketed and sigmoid scales."""
    p = profiles(t).where("technical is not null")
    return p.select("user_id", F.round(scores.log_scale(F.col("n"), 1000), 5).alias("volume"), scores.bracket(F.col("technical"), [(20, 10.0), (50, 40.0), (80, 70.0)], 95.0).alias("bracket"), F.round(scores.sigmoid_score(F.col("technical") / 10), 5).alias("gravity"))


@query(f"""WITH {PROFILE}, x AS (SELECT user_id, unnest([{{'pair': 'technical_financial', 'a': technical, 'b': financial, 'k': 30.0}}, {{'pair': 'technical_media', 'a': technical, 'b': media, 'k': 25.0}}, {{'pair': 'product_media', 'a': product, 'b': media, 'k': 25.0}}, {{'pair': 'company_financial', 'a': company, 'b': financial, 'k': 20.0}}]) AS s, kinds FROM p)
SELECT user_id, s.pair AS pair, round(abs(s.a - s.b), 3) AS magnitude, CASE WHEN s.a > s.b THEN 'opportunity' ELSE 'risk' END AS interpretation FROM x WHERE abs(s.a - s.b) >= s.k AND kinds >= 3""")
def divergences(t):
    """C11, Q16, Q20: pairs of categories that disagree beyond their thresholds."""
    pairs = [("technical", "financial", 30.0), ("technical", "media", 25.0), ("product", "media", 25.0), ("company", "financial", 20.0)]
    s = F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(k).alias("k")) for a, b, k in pairs])
    x = profiles(t).where("kinds >= 3").select("user_id", F.explode(s).alias("s")).select("user_id", "s.*").withColumn("gap", F.abs(F.col("a") - F.col("b"))).where("gap >= k")
    return x.select("user_id", "pair", F.round("gap", 3).alias("magnitude"), F.when(F.col("a") > F.col("b"), "opportunity").otherwise("risk").alias("interpretation"))


@query(f"""WITH {PROFILE} SELECT user_id, CASE WHEN media >= 70 AND technical < 50 THEN 'peak' WHEN media < 40 AND technical >= 60 THEN 'undervalued' WHEN technical >= 60 AND financial >= 60 THEN 'plateau' WHEN technical >= 40 AND media >= 40 THEN 'slope' WHEN media >= 30 THEN 'trigger' ELSE 'trough' END AS phase,
CASE WHEN technical >= 60 AND media - financial > 0 THEN 'scaling' WHEN technical >= 60 THEN 'mature' WHEN media - financial > 0 THEN 'emerging' WHEN media - financial < 0 THEN 'declining' ELSE 'steady' END AS lifecycle,
CASE WHEN technical >= 50 AND media >= 50 THEN 'leaders' WHEN technical >= 50 THEN 'builders' WHEN media >= 50 THEN 'talkers' ELSE 'quiet' END AS quadrant FROM p""")
def ladders(t):
    """Ordered rules."""
    te, m, f = F.col("technical"), F.col("media"), F.col("financial")
    return profiles(t).select("user_id", scores.hype_phase(te, m, f).alias("phase"), scores.lifecycle(te, m - f).alias("lifecycle"), scores.quadrant(te, m).alias("quadrant"))


@query("""WITH d AS (SELECT source, count(*) AS size, count(DISTINCT lang) AS langs, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1), e AS (SELECT source, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT source, n, sum(n) OVER (PARTITION BY source) AS t FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)) GROUP BY 1)
SELECT source, round(least(10.0, ln(1 + mean) + 0.25 * ln(1 + langs) + 0.15 * coalesce(entropy, 0) + 0.35 * least(size / 100.0, 1.0)), 5) AS rank_score FROM d JOIN e USING (source)""")
def cluster_ranks(t):
    """Rank scores of groups from gravity, breadth, entropy and size."""
    d = t("documents")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("lang").alias("langs"), F.round(F.avg("n_chars"), 6).alias("mean"))
    c = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    e = c.groupBy("source").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    score = F.log1p("mean") + 0.25 * F.log1p("langs") + 0.15 * F.coalesce("entropy", F.lit(0)) + 0.35 * F.least(F.col("size") / 100.0, F.lit(1.0))
    return g.join(e, "source").select("source", F.round(F.least(F.lit(10.0), score), 5).alias("rank_score"))


@query("""WITH m AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS recent FROM events GROUP BY ALL), s AS (SELECT user_id, count(*) AS types, sum(n)::BIGINT AS n, sum(recent)::BIGINT AS recent, count(*) FILTER (event_type = 'view') AS news FROM m GROUP BY 1)
SELECT user_id, round(least(100.0, 12 * types + 5 * log2(n + 1) + 25.0 * recent / n), 5) AS emergence, news = 0 AS stealth FROM s WHERE types >= 2""")
def emergence(t):
    """Entities that several kinds of source mention lately."""
    e = t("events")
    s = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("types"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).alias("recent"), F.count_if(F.col("event_type") == "view").alias("news"))
    x = 12 * F.col("types") + 5 * F.log2(F.col("n") + 1) + 25.0 * F.col("recent") / F.col("n")
    return s.where("types >= 2").select("user_id", F.round(F.least(F.lit(100.0), x), 5).alias("emergence"), (F.col("news") == 0).alias("stealth"))


@query("""WITH e AS (SELECT user_id, value, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 3.6e9 AS h, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.8 ELSE 0.5 END AS w FROM events), f AS (SELECT user_id, value, w * CASE WHEN h > 336 THEN 0.0 WHEN h <= 0 THEN 1.0 ELSE pow(0.5, h / 48.0) END AS k FROM e)
SELECT user_id, round(sum(value * k) / nullif(sum(k), 0), 4) AS signal, count(*) FILTER (k > 0) AS fresh FROM f GROUP BY 1""")
def calibrated_signals(t):
    """Means weighted by freshness and trust."""
    hours = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    w = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "signup", 0.8).otherwise(0.5)
    f = t("events").select("user_id", "value", (w * scores.freshness(hours, 48.0)).alias("k"))
    return f.groupBy("user_id").agg(F.round(F.try_divide(F.sum(F.col("value") * F.col("k")), F.sum("k")), 4).alias("signal"), F.count_if(F.col("k") > 0).alias("fresh"))


@query("""WITH w AS (SELECT user_id, ts, value, CASE WHEN value > 150 THEN 'critical' WHEN value > 100 THEN 'high' ELSE 'medium' END AS severity FROM events WHERE event_type = 'error' AND value > 60)
SELECT user_id, severity, count(*) AS n, min(ts) AS first, max(value) AS worst FROM w GROUP BY ALL""")
def bucket_alerts(t):
    """Alerts by severity."""
    v = F.col("value")
    w = t("events").where((F.col("event_type") == "error") & (v > 60)).withColumn("severity", F.when(v > 150, "critical").when(v > 100, "high").otherwise("medium"))
    return w.groupBy("user_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("value").alias("worst"))


@query("""SELECT c_mktsegment, count(*) AS positions, round(sum(l_quantity * p_retailprice), 2) AS worth, round(sum(l_extendedprice * (1 - l_discount)) - sum(l_quantity * p_retailprice), 2) AS gain
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1""")
def portfolio(t):
    """Positions valued by a price table."""
    l = t("lineitem").where(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    j = l.join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey")).join(t("part").select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"))
    worth = F.sum(F.col("l_quantity") * F.col("p_retailprice"))
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("positions"), F.round(worth, 2).alias("worth"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) - worth, 2).alias("gain"))


@query("""WITH a AS (SELECT user_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS resolved_at FROM events WHERE event_type = 'error' AND value > 80)
SELECT user_id, ts AS detected_at, resolved_at, resolved_at IS NULL AS active FROM a""")
def superseded_alerts(t):
    """An alert is closed by the next one of its entity."""
    a = t("events").where("event_type = 'error' and value > 80")
    return a.select("user_id", F.col("ts").alias("detected_at"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")).alias("resolved_at")).withColumn("active", F.col("resolved_at").isNull())
