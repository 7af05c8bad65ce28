"""Anomalies, warnings, staged matching, replays and exports."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, graphs, joins
from ..operators import statistics as st
from ..sources import sinks, tables
from . import content, series  # noqa: F401  (their SQL is built upon)
from .registry import ORACLE_SQL, query


@query(f"""WITH {series.WEEKLY},
b AS (SELECT seg, wk, n, avg(n) OVER p AS mean, stddev_samp(n) OVER p AS sd, count(*) OVER p AS k FROM w
  WINDOW p AS (PARTITION BY seg ORDER BY wk ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
z AS (SELECT seg, wk, CASE WHEN sd > 1e-9 THEN (n - mean) / sd ELSE 0.0 END AS z FROM b WHERE k >= 4),
c AS (SELECT *, greatest(-6.0::DOUBLE, least(6.0::DOUBLE, z)) AS x FROM z),
s AS (SELECT seg, wk, sum(pow(abs(x), 2 * k + 1) * sqrt(pi()) / (pow(2, k + 1) * gamma(k + 1.5))) AS s FROM c, range(100) r(k) GROUP BY ALL)
SELECT seg, wk::VARCHAR AS wk, round(z, 5) AS z, abs(z) > 2.5 AS anomaly,
  round(50 + sign(x) * 100 * exp(-x * x / 2) / sqrt(2 * pi()) * s, 4) AS percentile FROM c JOIN s USING (seg, wk)""")
def week_anomalies(t):
    """Each week against the 26 before: z-score, normal percentile, and whether it is 2.5 deviations away. Without spread z is 0 and the percentile 50."""
    p = Window.partitionBy("seg").orderBy("wk").rowsBetween(-26, -1)
    b = series.weekly(t).select("seg", "wk", "n", F.avg("n").over(p).alias("mean"), F.stddev_samp("n").over(p).alias("sd"), F.count(F.lit(1)).over(p).alias("k")).where("k >= 4")
    z = F.coalesce(F.when(F.col("sd") > 1e-9, (F.col("n") - F.col("mean")) / F.col("sd")), F.lit(0.0))
    d = b.select("seg", F.col("wk").cast("string").alias("wk"), z.alias("exact"))
    return d.select("seg", "wk", F.round("exact", 5).alias("z"), (F.abs("exact") > 2.5).alias("anomaly"), F.round(100 * st.normal_below(F.col("exact")), 4).alias("percentile"))


#: Kinds of entities and the words in names that tell them, in order of precedence.
KINDS = {"machine": ("widget", "gear", "motor"), "fastener": ("bolt", "screw", "ring"), "concept": ("safety", "ethics")}


@query("""SELECT kind, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'widget|gear|motor') THEN 'machine'
WHEN regexp_matches(lower(p_name), 'bolt|screw|ring') THEN 'fastener' WHEN regexp_matches(lower(p_name), 'safety|ethics') THEN 'concept' ELSE 'company' END AS kind FROM part) GROUP BY 1""")
def entity_kinds(t):
    """the kind of each named entity by the first list that has a part of its name, else company."""
    p = t("part").select("p_partkey", text.kind_of(F.col("p_name"), KINDS, "company").alias("kind"))
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


NAMED = "e AS (SELECT event_id, user_id, event_type, ts, event_type || ' ' || json_extract_string(props, '$.k') AS name FROM events)"


def named_events(t):
    return t("events").select("event_id", "user_id", "event_type", "ts", F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")).alias("name"))


@query(f"""WITH {NAMED} SELECT a.event_id AS a, b.event_id AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE, 6) AS similarity
FROM e a JOIN e b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) AND b.ts <= a.ts + INTERVAL 1 DAY
WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE >= 0.85""")
def repeated_signals(t):
    """Signals of one entity within a day of each other whose texts are equal or nearly so."""
    return dedup.near_in_time(named_events(t), "event_id", ["user_id"], "ts", "name", 1, 0.85).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {NAMED}, p AS (SELECT a.event_id AS a, b.event_id AS b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE AS s
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND (a.ts, a.event_id) < (b.ts, b.event_id) AND b.ts <= a.ts + INTERVAL 14 DAY)
SELECT b AS event_id, count(*) AS alike, max_by(a, (round(s, 6), -a)) AS likest, round(max(s), 6) AS similarity FROM p WHERE s >= 0.7 GROUP BY 1""")
def similar_events(t):
    """Earlier events of the same type and entity within 14 days with a name alike by 0.7: how many, and the likest."""
    p = dedup.near_in_time(named_events(t), "event_id", ["user_id", "event_type"], "ts", "name", 14, 0.7)
    likest = F.max_by("a", F.struct(F.round("similarity", 6), -F.col("a")))
    return p.groupBy(F.col("b").alias("event_id")).agg(F.count(F.lit(1)).alias("alike"), likest.alias("likest"), F.round(F.max("similarity"), 6).alias("similarity"))


FINGERPRINTS = f"f AS ({ORACLE_SQL['simhash_fingerprints']}), k AS (SELECT doc_id, fingerprint::UBIGINT AS h FROM f)"


@query(f"""WITH {FINGERPRINTS}, p AS (SELECT l.doc_id AS a, r.doc_id AS b, bit_count(xor(l.h, r.h)) AS d FROM k l JOIN k r ON l.doc_id < r.doc_id WHERE bit_count(xor(l.h, r.h)) <= 3)
SELECT b AS doc_id, min_by(a, (d, a)) AS best, min(d)::INT AS distance FROM p GROUP BY 1""")
def best_earlier_copy(t):
    """For each text the earlier one whose fingerprint is nearest, within three bits."""
    f = tables.settled(dedup.simhash(t("documents").where("text is not null"), "doc_id", "text"), "simhash")
    each = dedup.near_fingerprints(f, "doc_id")
    # The first of equal texts stands for them: it is the least of its distance.
    return each.groupBy(F.col("b").alias("doc_id")).agg(F.min_by("a", F.struct("distance", "a")).alias("best"), F.min("distance").alias("distance"))


@query(f"""WITH l AS ({ORACLE_SQL['lead_lag']}), g AS (SELECT lead AS leader, follow AS target, lag, r, n FROM l WHERE lag > 0 UNION ALL SELECT follow, lead, -lag, r, n FROM l WHERE lag < 0),
{series.DAILY}, m AS (SELECT event_type, day, v - avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS c FROM d),
c AS (SELECT event_type AS leader, max_by(c, day) AS c FROM m WHERE c IS NOT NULL GROUP BY 1)
SELECT leader, target, lag, r, CASE WHEN c >= 0 THEN 'positive' ELSE 'negative' END AS direction, round(abs(c), 4) AS magnitude,
  CASE WHEN (c >= 0) = (r > 0) THEN 'positive' ELSE 'negative' END AS expected, CASE WHEN n >= 24 THEN 'high' ELSE 'medium' END AS confidence FROM g JOIN c USING (leader) WHERE abs(r) > 0.3""")
def early_warnings(t):
    """The last change of each leading series, and the direction that it lets expect of those that follow."""
    l = series.lead_lag(t)
    ahead = l.where("lag > 0").select(F.col("lead").alias("leader"), F.col("follow").alias("target"), "lag", "r", "n")
    behind = l.where("lag < 0").select(F.col("follow").alias("leader"), F.col("lead").alias("target"), (-F.col("lag")).alias("lag"), "r", "n")
    before = F.avg("v").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-7, -1))
    c = series.daily(t).select(F.col("event_type").alias("leader"), "day", (F.col("v") - before).alias("c")).where("c is not null")
    c = c.groupBy("leader").agg(F.max_by("c", "day").alias("c"))
    return graphs.warnings_of(c, ahead.unionByName(behind), 0.3).withColumn("magnitude", F.round("magnitude", 4))


NATION_WEEKS = """nw AS (SELECT c_nationkey AS nation, date_trunc('week', o_orderdate)::DATE AS wk, sum(round(o_totalprice, 2)::DECIMAL(28, 2))::DOUBLE AS v
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def nation_weeks(t):
    o = t("orders").select("o_custkey", "o_orderdate", "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    total = F.sum(F.round("o_totalprice", 2).cast("decimal(28,2)")).cast("double")
    return o.groupBy(F.col("c_nationkey").alias("nation"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("wk")).agg(total.alias("v"))


@query(f"""WITH {NATION_WEEKS}, s AS (SELECT n_regionkey AS sector, wk, avg(v) AS v FROM nw JOIN nation ON n_nationkey = nation GROUP BY ALL)
SELECT a.sector AS a, b.sector AS b, round(corr(a.v, b.v), 5) AS r, count(*) AS n FROM s a JOIN s b ON a.wk = b.wk AND a.sector < b.sector GROUP BY ALL HAVING count(*) >= 10""")
def sector_heatmap(t):
    """Correlations between sectors, each the mean series of its members."""
    s = nation_weeks(t).join(t("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("sector")), "nation").groupBy("sector", "wk").agg(F.avg("v").alias("v"))
    return graphs.correlation_matrix(s, "sector", "wk", "v", 10).withColumn("r", F.round("r", 5))


@query(f"""WITH {NATION_WEEKS}, p AS (SELECT a.nation AS a, b.nation AS b, round(corr(a.v, b.v), 5) AS r FROM nw a JOIN nw b ON a.wk = b.wk AND a.nation < b.nation GROUP BY ALL HAVING count(*) >= 10),
e AS (SELECT a AS nation, b AS other, r FROM p UNION ALL SELECT b, a, r FROM p)
SELECT nation, other, r, (row_number() OVER (PARTITION BY nation ORDER BY abs(r) DESC, other))::INT AS place FROM e WHERE abs(r) >= 0.08""")
def correlated_entities(t):
    """For each entity those it moves with, either way, the strongest first; weekly orders of nations are nearly independent, hence the low bound."""
    p = graphs.correlation_matrix(nation_weeks(t), "nation", "wk", "v", 10).select("a", "b", F.round("r", 5).alias("r"))
    e = p.select(F.col("a").alias("nation"), F.col("b").alias("other"), "r").unionByName(p.select(F.col("b").alias("nation"), F.col("a").alias("other"), "r"))
    w = Window.partitionBy("nation").orderBy(F.desc(F.abs("r")), "other")
    return e.where(F.abs("r") >= 0.08).withColumn("place", F.row_number().over(w))


MENTIONS = """m AS (SELECT event_id, CASE user_id % 8 WHEN 0 THEN 'NATION_' || (user_id % 25) WHEN 1 THEN 'Nation 1' || (user_id % 10) || ' Ltd.' WHEN 2 THEN 'R' || (user_id % 8) WHEN 3 THEN 'https://www.n' || (user_id % 30) || '.example/about'
WHEN 4 THEN 'NATIOM_1' || (user_id % 10) WHEN 5 THEN 'NATION_2x' WHEN 6 THEN 'unknown' ELSE 'the old one' END AS name FROM events)"""


@query(f"""WITH {MENTIONS}, c AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '[\\s,]+(?:inc|corp|corporation|ltd|limited|llc|gmbh|co|company|plc|sa|ag)\\.?$', ''), '[^a-z0-9]+', '-', 'g') AS slug,
  nullif(regexp_replace(regexp_extract(lower(name), '^https?://([^/?#:]+)', 1), '^www\\.', ''), '') AS host FROM m),
s AS (SELECT c.event_id, c.name, CASE WHEN c.name = 'the old one' THEN 3 ELSE coalesce(n.n_nationkey, k.n_nationkey, 100 + a.r_regionkey, d.n_nationkey) END::BIGINT AS target,
  CASE WHEN c.name = 'the old one' THEN 'override' WHEN n.n_nationkey IS NOT NULL THEN 'name' WHEN k.n_nationkey IS NOT NULL THEN 'canonical' WHEN a.r_regionkey IS NOT NULL THEN 'alias' WHEN d.n_nationkey IS NOT NULL THEN 'domain' END AS tier
  FROM c LEFT JOIN nation n ON n.n_name = c.name LEFT JOIN nation k ON replace(lower(k.n_name), '_', '-') = c.slug LEFT JOIN region a ON 'R' || a.r_regionkey = c.name LEFT JOIN nation d ON 'n' || d.n_nationkey || '.example' = c.host),
q AS (SELECT DISTINCT name FROM s WHERE tier IS NULL AND name <> 'unknown'),
f AS (SELECT name, n_nationkey AS id, round(1 - levenshtein(lower(name), lower(n_name)) / greatest(length(name), length(n_name))::DOUBLE, 6) AS score FROM q, nation),
b AS (SELECT name, max(score) AS score FROM f WHERE score >= 0.85 GROUP BY 1), z AS (SELECT name, min(id) AS id, count(*) AS n, any_value(score) AS score FROM f JOIN b USING (name, score) GROUP BY 1)
SELECT event_id, CASE WHEN s.name = 'unknown' THEN NULL WHEN tier IS NOT NULL THEN target WHEN n = 1 THEN id END::BIGINT AS target,
  CASE WHEN s.name = 'unknown' THEN 'denied' WHEN tier IS NOT NULL THEN tier WHEN n = 1 THEN 'fuzzy' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS tier,
  CASE WHEN tier IS NULL AND n = 1 THEN least(score, 0.9) WHEN tier = 'domain' THEN 0.92 WHEN tier = 'alias' THEN 0.95 WHEN tier IS NOT NULL AND s.name <> 'unknown' THEN 1.0 ELSE 0.0 END AS confidence FROM s LEFT JOIN z USING (name)""")
def tiered_match(t):
    """Mentions to entities by override, name, canonical name, alias and domain; the distinct names left meet the entities by edit distance.

    Names on the deny list match nothing; of several equally near entities none is chosen. Confidence is capped by tier.
    """
    u = F.col("user_id")
    forms = [
        F.concat(F.lit("NATION_"), u % 25), F.concat(F.lit("Nation 1"), u % 10, F.lit(" Ltd.")), F.concat(F.lit("R"), u % 8), F.concat(F.lit("https://www.n"), u % 30, F.lit(".example/about")),
        F.concat(F.lit("NATIOM_1"), u % 10), F.lit("NATION_2x"), F.lit("unknown"),
    ]
    name = F.lit("the old one")
    for k, form in reversed(list(enumerate(forms))):
        name = F.when(u % 8 == k, form).otherwise(name)
    host = text.host(F.col("name"))
    m = t("events").select("event_id", name.alias("name")).withColumn("slug", text.entity_id(F.col("name"))).withColumn("host", F.when(host != "unknown", host))
    n = t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("target"))
    override = n.sparkSession.createDataFrame([("the old one", 3)], "name string, target long")
    domains = n.select(F.concat(F.lit("n"), "target", F.lit(".example")).alias("host"), "target")
    alias = t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("name"), (F.col("r_regionkey") + 100).cast("long").alias("target"))
    steps = [("override", "name", override, 1.0), ("name", "name", n, 1.0), ("canonical", "slug", n.select(text.entity_id(F.col("name")).alias("slug"), "target"), 1.0), ("alias", "name", alias, 0.95), ("domain", "host", domains, 0.92)]
    return joins.tiers(m, "name", steps, n, ["unknown"], 0.85, 0.9).select("event_id", "target", "tier", "confidence")


@query("""WITH r AS (SELECT d.doc_id, l.quality, d.n_chars, row_number() OVER (ORDER BY d.doc_id) - 1 AS p, count(*) OVER () AS n FROM documents d JOIN labels l USING (doc_id)),
f AS (SELECT *, floor(n * 0.7)::INT AS first, greatest(1, (n - floor(n * 0.7)::INT) // 5) AS step FROM r), x AS (SELECT *, unnest(range(0, 5)) AS fold FROM f),
y AS (SELECT fold, p < first + fold * step AS train, quality, n_chars FROM x WHERE p < first + (fold + 1) * step),
m AS (SELECT fold, count(*) FILTER (train) AS n_train, avg(n_chars) FILTER (train AND quality = 1) AS g, avg(n_chars) FILTER (train AND quality = 0) AS b FROM y GROUP BY 1),
q AS (SELECT fold, n_train, quality, CASE WHEN abs(n_chars - g) + abs(n_chars - b) > 0 THEN abs(n_chars - b) / (abs(n_chars - g) + abs(n_chars - b)) ELSE 0.5 END AS p FROM y JOIN m USING (fold) WHERE NOT train)
SELECT fold::INT AS fold, any_value(n_train) AS n_train, count(*) AS n_test, round(avg(p), 6) AS forecast, round(avg(CASE WHEN (p >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM q GROUP BY 1""")
def called_forward(t):
    """Expanding folds judged by a prediction function of one's own, which gets what the training rows sum up to and a batch of test rows."""

    def predict(rows: pd.DataFrame) -> pd.Series:
        good, bad = (rows.n_chars - rows.g).abs(), (rows.n_chars - rows.b).abs()
        return (bad / (good + bad)).where(good + bad > 0, 0.5)

    d = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    y = st.walk_forward(d, ["doc_id"], d.count())
    mean = lambda k: F.avg(F.when(F.col("quality") == k, F.col("n_chars")))
    q = st.called_forward(y, [F.count(F.lit(1)).alias("n_train"), mean(1).alias("g"), mean(0).alias("b")], predict)
    hit = F.when((F.col("prediction") >= 0.5) == (F.col("quality") == 1), 1.0).otherwise(0.0)
    return q.groupBy("fold").agg(F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"), F.round(F.avg("prediction"), 6).alias("forecast"), F.round(F.avg(hit), 6).alias("accuracy"))


@query("""WITH f AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL), c AS (SELECT min(day) AS a, max(day) AS b FROM f),
k AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM f), c),
u AS (SELECT k.user_id, k.day, max(f.day) AS used, max_by(f.n, f.day) AS n FROM k LEFT JOIN f ON f.user_id = k.user_id AND f.day BETWEEN k.day - 3 AND k.day GROUP BY ALL)
SELECT day::VARCHAR AS day, count(*) FILTER (used = day) AS fresh, count(*) FILTER (used < day) AS fallback, count(*) FILTER (used IS NULL) AS skipped, coalesce(sum(n), 0)::BIGINT AS signals FROM u GROUP BY 1""")
def replayed_days(t):
    """X11: all days replayed for each entity: its feed of the day, else the newest of the three days before, else none."""
    f = t("events").where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return joins.replay(tables.settled(f, "feeds"), "user_id", "day", "n", 3).withColumn("day", F.col("day").cast("string"))


@query("""WITH g AS (SELECT date_trunc('week', ts)::DATE AS wk, event_type, count(*) AS n, sum(round(value, 2)::DECIMAL(28, 2))::DOUBLE AS total FROM events GROUP BY ALL), f(kind) AS (VALUES ('csv'), ('json'), ('parquet'))
SELECT kind, wk::VARCHAR AS wk, event_type, n, total FROM g, f UNION ALL SELECT 'snapshot', wk::VARCHAR, event_type, CASE WHEN wk = (SELECT max(wk) FROM g) THEN 2 * n ELSE n END, total FROM g""")
def exports(t):
    """Results written as compressed CSV, JSON lines and Parquet and read back; a snapshot whose last week is written anew."""
    total = F.sum(F.round("value", 2).cast("decimal(28,2)")).cast("double")
    g = tables.settled(t("events").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("wk"), "event_type").agg(F.count(F.lit(1)).alias("n"), total.alias("total")), "weeks")
    spark, base = g.sparkSession, f"{tables.shared_folder(g.sparkSession)}/export-{uuid.uuid4().hex}"
    parts = {}
    for kind in ("csv", "json", "parquet"):
        sinks.export(g, f"{base}/{kind}", kind, None if kind == "parquet" else "gzip")
        parts[kind] = spark.read.schema(g.schema).option("header", True).format(kind).load(f"{base}/{kind}")
    sinks.snapshot(g, f"{base}/snapshot", "wk")
    last = g.agg(F.max("wk").alias("wk"))
    sinks.snapshot(g.join(last, "wk", "left_semi").withColumn("n", 2 * F.col("n")), f"{base}/snapshot", "wk")
    parts["snapshot"] = spark.read.schema(g.schema).parquet(f"{base}/snapshot")
    return tables.union_sources(parts).select(F.col("origin").alias("kind"), "wk", "event_type", "n", "total")


@query("""SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY ALL""")
def day_file_range(t):
    """JSON-lines files by day, of which a range of days is read; days outside are never opened."""
    e = t("events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    path = f"{tables.shared_folder(e.sparkSession)}/days-{uuid.uuid4().hex}"
    e.write.partitionBy("day").json(path)
    d = tables.day_files(e.sparkSession, f"{path}/*", "event_id long, event_type string", "2024-01-08", "2024-01-21")
    return d.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
