"""Feeds, summaries, merges and profiles over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import dedup
from ..sources.tables import settled
from . import scoring
from .registry import ORACLE_SQL, query


@query("""
WITH e AS (SELECT user_id || '|' || event_type || '|' || (ts::DATE)::VARCHAR AS item, event_id, value, ts FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
g AS (
  SELECT item, count(*) AS n, max_by(event_id, (coalesce(value, '-inf'::DOUBLE), -event_id)) AS best, max_by(value, (coalesce(value, '-inf'::DOUBLE), -event_id)) AS top,
    max_by(event_id, (ts, -event_id)) AS newest, max_by(value, (ts, -event_id)) AS last, min(event_id) AS first, avg(value) AS mean
  FROM e GROUP BY 1 HAVING count(*) > 1)
SELECT item, 'higher_score' AS strategy, best AS event_id, top AS value, n AS n_merged FROM g UNION ALL SELECT item, 'smart', best, top, n FROM g
UNION ALL SELECT item, 'recent', newest, last, n FROM g UNION ALL SELECT item, 'combined', first, round(mean, 6), n FROM g""")
def merge_strategies(t):
    """Events of one entity, type and day merged by score, by time, by the mean and by score with all noted."""
    item = F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type", F.lit("|"), F.to_date("ts").cast("string"))
    e = t("events").select(item.alias("item"), "event_id", "value", "ts")
    return dedup.merged_ways(e, "item", "event_id", "value", "ts").withColumn("value", F.round("value", 6))


@query("""
WITH x AS (SELECT 'events' AS feed, md5(text) AS item, n_chars FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'themes', source || '/' || lang, n_chars FROM documents),
g AS (SELECT feed, item, count(*) AS size, round(ln(1 + avg(n_chars)) + 2 * log2(1 + count(*)), 6) AS score FROM x WHERE item IS NOT NULL GROUP BY ALL),
s AS (SELECT feed, count(*) FILTER (size > 1) AS clusters, count(*) FILTER (size = 1) AS singletons FROM g GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY score DESC, item) AS place FROM g)
SELECT feed, place::INT AS place, item, size, score, clusters, singletons FROM r JOIN s USING (feed) WHERE place <= 30""")
def dual_feed(t):
    """Two feeds ranked apart, equal texts as events and source with language as themes: the thirty best of each, with how many clusters and single rows it was drawn from."""
    d = t("documents").select("text", "source", "lang", "n_chars")
    kinds = {"events": F.md5("text"), "themes": F.concat("source", F.lit("/"), "lang")}
    score = F.round(F.log1p(F.avg("n_chars")) + 2 * F.log2(1 + F.count(F.lit(1))), 6)
    feeds = []
    for feed, item in kinds.items():
        g = settled(d.select(item.alias("item"), "n_chars").where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("size"), score.alias("score")), feed)
        whole = g.agg(F.count_if(F.col("size") > 1).alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"))  # one row
        best = g.orderBy(F.desc("score"), "item").limit(30).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "item")))  # thirty rows
        feeds.append(best.join(F.broadcast(whole)).select(F.lit(feed).alias("feed"), "place", "item", "size", "score", "clusters", "singletons"))
    return feeds[0].unionByName(feeds[1])


@query(f"""
WITH d AS ({ORACLE_SQL["divergences"]}),
r AS (SELECT *, row_number() OVER (PARTITION BY interpretation ORDER BY magnitude DESC, user_id, pair) AS place FROM d),
p AS (SELECT pair, count(*) AS n FROM d GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d WHERE interpretation = 'opportunity') AS opportunities, (SELECT count(*) FROM d WHERE interpretation = 'risk') AS risks,
  (SELECT string_agg(pair || '=' || n, ',' ORDER BY pair) FROM p) AS by_pair,
  (SELECT string_agg(user_id || ':' || pair, ',' ORDER BY place) FROM r WHERE interpretation = 'opportunity' AND place <= 5) AS top_opportunities,
  (SELECT string_agg(user_id || ':' || pair, ',' ORDER BY place) FROM r WHERE interpretation = 'risk' AND place <= 5) AS top_risks""")
def divergence_summary(t):
    """One row: how many divergences, by meaning and by pair of categories, and the five largest of each meaning."""
    d = settled(scoring.divergences(t), "divergences")
    means = lambda k: F.count_if(F.col("interpretation") == k)
    whole = d.agg(F.count(F.lit(1)).alias("total"), means("opportunity").alias("opportunities"), means("risk").alias("risks"))
    pairs = d.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))  # four at most
    by_pair = pairs.agg(F.array_join(F.array_sort(F.collect_list(F.concat("pair", F.lit("="), F.col("n").cast("string")))), ",").alias("by_pair"))

    def top(kind, name):
        best = d.where(F.col("interpretation") == kind).orderBy(F.desc("magnitude"), "user_id", "pair").limit(5)
        rows = F.array_sort(F.collect_list(F.struct((-F.col("magnitude")).alias("m"), "user_id", "pair")))
        return best.agg(F.array_join(F.transform(rows, lambda x: F.concat(x["user_id"].cast("string"), F.lit(":"), x["pair"])), ",").alias(name))

    out = whole
    for one in (by_pair, top("opportunity", "top_opportunities"), top("risk", "top_risks")):
        out = out.join(F.broadcast(one))  # one row each
    return out.select("total", "opportunities", "risks", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("by_pair", "top_opportunities", "top_risks")])


@query("""
WITH w AS (
  SELECT p_brand AS brand, p_type AS kind_of, date_trunc('week', l_shipdate)::DATE AS week, round(avg(100 * (0.1 - l_discount)), 6) AS mood, round(avg(l_extendedprice / l_quantity), 4) AS price
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
c AS (SELECT *, 100 * (price - lag(price, 5) OVER o) / abs(lag(price, 5) OVER o) AS change FROM w WINDOW o AS (PARTITION BY brand, kind_of ORDER BY week)),
k AS (
  SELECT *, CASE WHEN change > 3 AND mood < 3.5 THEN 'price_leads' WHEN change < -3 AND mood > 6.5 THEN 'mood_leads' WHEN change BETWEEN -3 AND 3 AND (mood > 6.5 OR mood < 3.5) THEN 'anticipation' END AS kind,
    least(50.0, abs(change) * 10) + 10 * abs(mood - 5) AS magnitude FROM c)
SELECT brand, kind_of, week::VARCHAR AS week, kind, round(magnitude, 3) AS magnitude, CASE WHEN magnitude >= 70 THEN 'strong' WHEN magnitude >= 50 THEN 'moderate' ELSE 'weak' END AS strength FROM k WHERE kind IS NOT NULL AND magnitude >= 40""")
def price_divergences(t):
    """Weeks of a brand and type whose price moves against the mood (by discount), or stands still under a marked one; five weeks make the change."""
    l = t("lineitem").select("l_partkey", "l_shipdate", "l_discount", "l_extendedprice", "l_quantity")
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind_of"))
    price = F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4)
    w = l.join(p, "l_partkey").groupBy("brand", "kind_of", F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"))
    w = w.agg(F.round(F.avg(100 * (0.1 - F.col("l_discount"))), 6).alias("mood"), price.alias("price"))
    old = F.lag("price", 5).over(Window.partitionBy("brand", "kind_of").orderBy("week"))  # a row for each week
    c = w.withColumn("change", 100 * F.try_divide(F.col("price") - old, F.abs(old))).withColumn("d", scores.price_divergence(F.col("change"), F.col("mood"))).where("d is not null")
    return c.select("brand", "kind_of", F.col("week").cast("string").alias("week"), "d.kind", F.round("d.magnitude", 3).alias("magnitude"), "d.strength")


@query(f"""
WITH {scoring.PROFILE}, c AS (SELECT c_mktsegment AS vertical, c_nationkey AS bucket, technical, media, financial FROM p JOIN customer ON c_custkey = user_id),
b AS (SELECT bucket, avg(technical) AS technical, avg(media) AS media, avg(financial) AS financial FROM c GROUP BY 1),
u AS (
  SELECT vertical, 1.0::DOUBLE AS w, nullif(technical, 50) AS technical, nullif(media, 50) AS media, nullif(financial, 50) AS financial FROM c
  UNION ALL SELECT vertical, 3.0, b.technical, b.media, b.financial FROM (SELECT DISTINCT vertical, bucket FROM c WHERE bucket IS NOT NULL) JOIN b USING (bucket)),
m AS (
  SELECT vertical, count(*) FILTER (w = 1) AS companies, count(*) FILTER (w = 3) AS buckets, coalesce(sum(w * technical) / sum(w) FILTER (technical IS NOT NULL), 50) AS technical,
    coalesce(sum(w * media) / sum(w) FILTER (media IS NOT NULL), 50) AS media, coalesce(sum(w * financial) / sum(w) FILTER (financial IS NOT NULL), 50) AS financial
  FROM u GROUP BY 1)
SELECT vertical, companies, buckets, round(technical, 4) AS technical, round(media, 4) AS media, round(financial, 4) AS financial,
  CASE WHEN media >= 70 AND technical < 50 THEN 'peak' WHEN media < 40 AND technical >= 60 THEN 'undervalued' WHEN technical >= 60 AND financial >= 60 THEN 'plateau' WHEN technical >= 40 AND media >= 40 THEN 'slope' WHEN media >= 30 THEN 'trigger' ELSE 'trough' END AS phase
FROM m""")
def vertical_profiles(t):
    """Segments as verticals: means over their customers' signals (50 is no signal) and, three times as heavy, those of the nations that they are in; 50 without any."""
    names = ("technical", "media", "financial")
    own = scoring.profiles(t).select(F.col("user_id").alias("c_custkey"), *names)
    c = settled(t("customer").select("c_custkey", F.col("c_mktsegment").alias("vertical"), F.col("c_nationkey").alias("bucket")).join(own, "c_custkey"), "companies")
    b = c.where("bucket is not null").groupBy("bucket").agg(*[F.avg(n).alias(n) for n in names])
    near = c.select("vertical", "bucket").distinct().join(b, "bucket").select("vertical", F.lit(3.0).alias("w"), *names)
    u = c.select("vertical", F.lit(1.0).alias("w"), *[F.nullif(F.col(n), F.lit(50.0)).alias(n) for n in names]).unionByName(near)
    mean = lambda n: F.coalesce(F.try_divide(F.sum(F.col("w") * F.col(n)), F.sum(F.when(F.col(n).isNotNull(), F.col("w")))), F.lit(50.0))
    m = u.groupBy("vertical").agg(F.count_if(F.col("w") == 1).alias("companies"), F.count_if(F.col("w") == 3).alias("buckets"), *[mean(n).alias(n) for n in names])
    return m.select("vertical", "companies", "buckets", *[F.round(n, 4).alias(n) for n in names], scores.hype_phase(*[F.col(n) for n in names]).alias("phase"))
