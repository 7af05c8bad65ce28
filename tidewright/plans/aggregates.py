"""Aggregation, ranking and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import dedup
from .registry import query

NOW_DAY = "2024-01-31"


def age():
    return F.datediff(F.lit(NOW_DAY).cast("date"), F.to_date("ts"))


@query("""SELECT event_type, count(*) AS n, sum((value > 50)::INT)::BIGINT AS strong, sum((value <= 50 AND user_id % 2 = 0)::INT)::BIGINT AS weak_even, round(avg(value) FILTER (value > 50), 6) AS strong_mean,
min(value) AS low, max(value) AS high FROM events GROUP BY 1""")
def conditional_counts(t):
    """Counts and means under conditions."""
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(v > 50).alias("strong"), F.count_if((v <= 50) & (F.col("user_id") % 2 == 0)).alias("weak_even"), F.round(F.avg(F.when(v > 50, v)), 6).alias("strong_mean"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("SELECT event_type, ts::DATE::VARCHAR AS day, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY ALL")
def distinct_users(t):
    """Distinct entities by day and type."""
    return t("events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT * FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM l GROUP BY 1""")
def latest_then_grouped(t):
    """Statistics over the newest row of each entity."""
    e = t("events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "ts").alias("r")).select("user_id", "r.*")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("users"))


@query("SELECT lower(p_name) AS name, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t):
    """Names on several rows, with their brands."""
    return t("part").groupBy(F.lower("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands")).where("n > 1")


@query("""SELECT CASE WHEN d <= 1 THEN 'day' WHEN d <= 7 THEN 'week' WHEN d <= 14 THEN 'fortnight' ELSE 'older' END AS age, count(*) AS n, round(avg(value), 6) AS mean
FROM (SELECT value, date_diff('day', ts::DATE, DATE '2024-01-31') AS d FROM events) GROUP BY 1""")
def age_buckets(t):
    """Rows by age."""
    d = age()
    b = F.when(d <= 1, "day").when(d <= 7, "week").when(d <= 14, "fortnight").otherwise("older")
    return t("events").groupBy(b.alias("age")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT c_custkey, coalesce(round(avg(value) FILTER (event_type = 'click'), 6), 50.0) AS click, coalesce(round(avg(value) FILTER (event_type = 'purchase'), 6), 50.0) AS purchase, coalesce(round(avg(value) FILTER (event_type = 'view'), 6), 50.0) AS viewed
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""")
def category_means(t):
    """A10: means by category, 50 where there is none."""
    m = t("events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.round(F.avg("value"), 6))
    c = t("customer")
    return c.join(m, c.c_custkey == m.user_id, "left").select("c_custkey", *[F.coalesce(k, F.lit(50.0)).alias(n) for k, n in (("click", "click"), ("purchase", "purchase"), ("view", "viewed"))])


@query("""SELECT isoyear(ts) * 100 + week(ts) AS iso_week, user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top, min_by(event_type, ts) AS first_type FROM events GROUP BY ALL""")
def weekly_mentions(t):
    """Mentions by ISO week."""
    week = (F.extract(F.lit("YEAROFWEEK"), "ts") * 100 + F.weekofyear("ts")).cast("long").alias("iso_week")
    return t("events").groupBy(week, "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"), F.min_by("event_type", "ts").alias("first_type"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts::DATE >= DATE '2024-01-22' GROUP BY ALL)
SELECT user_id, count(*) AS pipelines, sum(n)::BIGINT AS mentions, max_by(event_type, (n, event_type)) AS dominant FROM c GROUP BY 1 HAVING count(*) >= 3""")
def across_pipelines(t):
    """Entities that several pipelines mention, and the one that does most."""
    c = t("events").where(F.to_date("ts") >= "2024-01-22").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("pipelines"), F.sum("n").alias("mentions"), F.max_by("event_type", F.struct("n", "event_type")).alias("dominant")).where("pipelines >= 3")


@query("""SELECT user_id, n7, n30, round(n30 / 4.3, 6) AS weekly, n7 > 1.5 * n30 / 4.3 AS accelerating, types FROM (
SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS n7, count(*) FILTER (ts >= TIMESTAMP '2024-01-01') AS n30, count(DISTINCT event_type) AS types FROM events GROUP BY 1)""")
def mention_velocity(t):
    """Mentions in 7 and 30 days."""
    since = lambda d: F.count_if(F.col("ts") >= F.lit(d).cast("timestamp_ntz"))
    g = t("events").groupBy("user_id").agg(since("2024-01-24").alias("n7"), since("2024-01-01").alias("n30"), F.count_distinct("event_type").alias("types"))
    return g.select("user_id", "n7", "n30", F.round(F.col("n30") / 4.3, 6).alias("weekly"), (F.col("n7") > 1.5 * F.col("n30") / 4.3).alias("accelerating"), "types")


@query("""SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, count(DISTINCT lang) AS langs, list_sort(list(DISTINCT lang)) AS lang_list FROM documents GROUP BY 1""")
def article_statistics(t):
    """Size and variety of each source's articles."""
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count_distinct("lang").alias("langs"), F.array_sort(F.collect_set("lang")).alias("lang_list"))


@query("""SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, count(*) AS n FROM events GROUP BY 1""")
def score_distribution(t):
    """The upper median by rank, so that no group is gathered."""
    w = Window.partitionBy("event_type")
    hist = t("events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    hist = hist.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    return hist.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.sum(F.col("value") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("value"))).alias("upper_median"), F.max("n").alias("n"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN coalesce(h, '') = '' THEN 'unknown' ELSE h END AS host, split_part(h, '.', -1) AS top FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS h FROM pages)),
c AS (SELECT top, host, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT top, n, sum(n) OVER (PARTITION BY top) AS total FROM c)
SELECT top, count(*) AS hosts, max(total)::BIGINT AS pages, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(-sum(n / total * log2(n / total)), 6) END AS entropy FROM s GROUP BY 1""")
def domain_entropy(t):
    """Entropy of hosts."""
    p = t("pages").select(text.host(F.col("url")).alias("host")).withColumn("top", F.element_at(F.split("host", r"\."), -1))
    c = p.groupBy("top", "host").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("top")))
    share = F.col("n") / F.col("total")
    return c.groupBy("top").agg(F.count(F.lit(1)).alias("hosts"), F.max("total").alias("pages"), F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.round(-F.sum(share * F.log2(share)), 6)).alias("entropy"))


@query("SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS span_hours FROM events GROUP BY 1 HAVING count(*) >= 2")
def time_spans(t):
    """Hours between the first and the last mention."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t("events").groupBy("user_id").agg(F.round((us(F.max("ts")) - us(F.min("ts"))) / 3.6e9, 6).alias("span_hours"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@query("""WITH p AS (SELECT user_id, max_by(value, ts) FILTER (event_type = 'click') AS technical, max_by(value, ts) FILTER (event_type = 'view') AS media, max_by(value, ts) FILTER (event_type = 'purchase') AS financial, max_by(value, ts) FILTER (event_type = 'signup') AS product FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1),
s AS (SELECT *, (technical IS NOT NULL)::INT + (media IS NOT NULL)::INT + (financial IS NOT NULL)::INT + (product IS NOT NULL)::INT AS present,
(coalesce(technical * 0.3, 0) + coalesce(media * 0.2, 0) + coalesce(financial * 0.3, 0) + coalesce(product * 0.2, 0)) / (CASE WHEN technical IS NOT NULL THEN 0.3 ELSE 0.0 END + CASE WHEN media IS NOT NULL THEN 0.2 ELSE 0.0 END + CASE WHEN financial IS NOT NULL THEN 0.3 ELSE 0.0 END + CASE WHEN product IS NOT NULL THEN 0.2 ELSE 0.0 END)::DOUBLE AS mean FROM p WHERE coalesce(technical, media, financial, product) IS NOT NULL)
SELECT user_id, present, round(mean * CASE WHEN present <= 1 THEN 0.5 WHEN present = 2 THEN 0.75 WHEN present = 3 THEN 0.9 ELSE 1.0 END, 6) AS composite FROM s""")
def composite_scores(t):
    """Newest score by category, weighted, and held down by thin coverage."""
    kinds = {"technical": ("click", 0.3), "media": ("view", 0.2), "financial": ("purchase", 0.3), "product": ("signup", 0.2)}
    e = t("events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    p = e.groupBy("user_id").agg(*[F.max_by(F.when(F.col("event_type") == k, F.col("value")), F.when(F.col("event_type") == k, F.col("ts"))).alias(n) for n, (k, _) in kinds.items()])
    p = p.where(F.coalesce(*kinds).isNotNull()).withColumn("present", sum((F.col(c).isNotNull().cast("int") for c in list(kinds)[1:]), F.col("technical").isNotNull().cast("int")))
    mean = scores.weighted_mean({n: (F.col(n), w) for n, (_, w) in kinds.items()})
    return p.select("user_id", "present", F.round(mean * scores.coverage_penalty(F.col("present")), 6).alias("composite"))


@query("""SELECT r_name, count(user_id) AS n, coalesce(round(avg(value), 6), 0.0) AS impact FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT user_id, value FROM events WHERE value > 100) e ON user_id = c_custkey GROUP BY 1""")
def sector_means(t):
    """Mean of a sector's members, 0 without any."""
    c = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    e = t("events").where("value > 100").select("user_id", "value")
    return c.join(e, F.col("c_custkey") == F.col("user_id"), "left").groupBy("r_name").agg(F.count("user_id").alias("n"), F.coalesce(F.round(F.avg("value"), 6), F.lit(0.0)).alias("impact"))


@query("""SELECT l_returnflag AS mechanism, count(*) AS n, round(avg(d), 6) AS mean_days, median(d) AS median_days, min(d) AS low, max(d) AS high, count(*) FILTER (d >= 7) AS week, count(*) FILTER (d >= 21) AS three_weeks
FROM (SELECT l_returnflag, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate) GROUP BY 1""")
def lead_times(t):
    """Days from forecast to event, for those that came after it."""
    j = t("lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    d = F.datediff("l_shipdate", "o_orderdate").cast("long")
    g = j.select(F.col("l_returnflag").alias("mechanism"), d.alias("d")).groupBy("mechanism")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean_days"), F.median("d").alias("median_days"), F.min("d").alias("low"), F.max("d").alias("high"), F.count_if(F.col("d") >= 7).alias("week"), F.count_if(F.col("d") >= 21).alias("three_weeks"))


@query("""WITH w(event_type, w) AS (VALUES ('purchase', 1.0), ('signup', 0.8), ('click', 0.5), ('view', 0.3))
SELECT user_id, round(sum(value * coalesce(w, 0.2)) / sum(coalesce(w, 0.2)), 6) AS mean, round(avg(value) FILTER (coalesce(w, 0.2) >= 0.7), 6) AS trusted, round(avg(value) FILTER (coalesce(w, 0.2) < 0.7), 6) AS rest FROM events LEFT JOIN w USING (event_type) GROUP BY 1""")
def source_weighted(t):
    """Means weighted by trust in the source, 0.2 for an unknown one."""
    w = t("events").sparkSession.createDataFrame([("purchase", 1.0), ("signup", 0.8), ("click", 0.5), ("view", 0.3)], "event_type string, w double")
    j = t("events").join(F.broadcast(w), "event_type", "left").withColumn("w", F.coalesce("w", F.lit(0.2)))  # w: four rows
    v, k = F.col("value"), F.col("w")
    return j.groupBy("user_id").agg(F.round(F.sum(v * k) / F.sum(k), 6).alias("mean"), F.round(F.avg(F.when(k >= 0.7, v)), 6).alias("trusted"), F.round(F.avg(F.when(k < 0.7, v)), 6).alias("rest"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def rolled_up(t):
    """Subtotals."""
    j = t("orders").select("o_custkey", "o_orderpriority", "o_totalprice").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return j.rollup("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH q AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents), top AS (SELECT *, 'score' AS reason FROM q WHERE r <= 7),
rest AS (SELECT doc_id, source, n_chars, 'novelty' AS reason, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM q WHERE r > 7)
SELECT doc_id, source, reason FROM top UNION ALL SELECT doc_id, source, reason FROM rest WHERE r <= 3""")
def quality_and_novelty(t):
    """The seven best of each source, then three of the rest by another measure."""
    w = lambda *o: F.row_number().over(Window.partitionBy("source").orderBy(*o))
    q = t("documents").select("doc_id", "source", "n_chars").withColumn("r", w(F.desc("n_chars"), "doc_id"))
    rest = q.where("r > 7").withColumn("r", w("n_chars", "doc_id")).where("r <= 3")
    return q.where("r <= 7").select("doc_id", "source", F.lit("score").alias("reason")).unionByName(rest.select("doc_id", "source", F.lit("novelty").alias("reason")))


@query("""SELECT user_id, round(sum(value * pow(0.5, date_diff('day', ts::DATE, DATE '2024-01-31') / 7.0)), 6) AS heat, count(*) AS n FROM events GROUP BY 1 ORDER BY heat DESC, user_id LIMIT 30""")
def recency_ranking(t):
    """Entities by scores that fade with age."""
    heat = F.sum(F.col("value") * scores.recency(age(), 7.0))
    return t("events").groupBy("user_id").agg(F.round(heat, 6).alias("heat"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("heat"), "user_id").limit(30)


@query("""WITH w AS (SELECT user_id, isoyear(ts) * 100 + week(ts) AS wk, sum(value) AS s FROM events GROUP BY ALL), r AS (SELECT user_id, wk, round(s, 4) AS score, row_number() OVER (PARTITION BY wk ORDER BY round(s, 4) DESC, user_id) AS place FROM w)
SELECT *, lag(place) OVER (PARTITION BY user_id ORDER BY wk) - place AS climbed FROM r""")
def leaderboard(t):
    """Places by week and how many each entity has climbed."""
    wk = (F.extract(F.lit("YEAROFWEEK"), "ts") * 100 + F.weekofyear("ts")).cast("long").alias("wk")
    r = t("events").groupBy("user_id", wk).agg(F.round(F.sum("value"), 4).alias("score"))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("wk").orderBy(F.desc("score"), "user_id")).cast("long"))
    return r.withColumn("climbed", F.lag("place").over(Window.partitionBy("user_id").orderBy("wk")) - F.col("place"))


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-11'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT *, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'gone' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(t):
    """What two sets share and what one lacks."""
    e = t("events").select("user_id", "event_type", "ts")
    a, b = (e.where(c).select("user_id", "event_type").distinct() for c in ("ts < timestamp_ntz '2024-01-11'", "ts >= timestamp_ntz '2024-01-20'"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("gone")))


@query("""SELECT md5(concat_ws('|', lower(trim(user_id::VARCHAR)), lower(trim(event_type)), (ts::DATE)::VARCHAR)) AS fingerprint, min(event_id) AS event_id, count(*) AS n_copies FROM events GROUP BY 1""")
def exact_dedup(t):
    """One row for each fingerprint of entity, type and day."""
    f = text.fingerprint(F.col("user_id"), F.col("event_type"), F.to_date("ts"))
    return dedup.first_of(t("events").select("event_id", f.alias("fingerprint")), ["fingerprint"], ["event_id"])


@query("""SELECT md5(text) AS text_key, min(doc_id) AS doc_id, count(*) AS n_merged, max(n_chars) AS n_chars FROM documents GROUP BY 1 HAVING count(*) > 1""")
def merged_copies(t):
    """Groups of copies merged into their first row."""
    m = dedup.merged(t("documents").select(F.md5("text").alias("text_key"), "doc_id", "n_chars"), "text_key", "n_chars", "doc_id")
    return m.where("n_merged > 1").select("text_key", "doc_id", "n_merged", "n_chars")
