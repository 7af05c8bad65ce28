"""Parameterised reads and joins over events (entity user_id, category event_type, score value), customers and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters, joins
from ..sources import sinks, tables
from .registry import query

NOW = "2024-01-31"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query("""SELECT event_id, user_id, event_type AS category, value AS score FROM events
WHERE value > 20 AND (event_type IN ('purchase', 'signup') OR value BETWEEN 90 AND 110) AND NOT (user_id < 10) AND event_type <> 'error'""")
def boolean_filter(t):
    """Q01-Q12: a query given as JSON, with nesting, membership, ranges and aliases."""
    q = {"where": [{"field": "value", "op": ">", "value": 20}, {"or": [{"field": "event_type", "op": "in", "value": ["purchase", "signup"]}, {"field": "value", "op": "between", "value": [90, 110]}]}, {"not": {"field": "user_id", "op": "<", "value": 10}}, {"field": "event_type", "op": "<>", "value": "error"}]}
    e = t("events")
    return e.where(filters.condition(e, q["where"])).select("event_id", "user_id", F.col("event_type").alias("category"), F.col("value").alias("score"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top, count(DISTINCT user_id) AS users FROM events
WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY event_type HAVING count(*) > 10 ORDER BY n DESC, event_type LIMIT 100""")
def grouped_having(t):
    """Aggregates with aliases, a condition on groups, order and limit."""
    e = t("events").where(F.col("ts") >= at("2024-01-05"))
    q = {"group_by": ["event_type"], "aggregate": [{"fn": "count", "as": "n"}, {"fn": "avg", "field": "value", "as": "mean"}, {"fn": "max", "field": "value", "as": "top"}, {"fn": "count_distinct", "field": "user_id", "as": "users"}], "having": {"field": "n", "op": ">", "value": 10}, "order_by": [{"field": "n", "desc": True}, {"field": "event_type"}]}
    return filters.boolean_query(e, q).withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 50")
def ordered_page(t):
    """The third page of 25 in a total order."""
    return t("events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").offset(50).limit(25)


@query("""
WITH p AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS k, count(*) OVER () AS total FROM events WHERE value IS NOT NULL)
SELECT event_id, user_id, value, total, ceil(total / 40.0)::BIGINT AS total_pages, ceil(total / 40.0) > 5 AS has_next, true AS has_prev FROM p WHERE k >= 160 AND k < 200""")
def counted_page(t):
    """The fifth page of forty in a total order, with what an export says of its pages."""
    rows, about = sinks.page(t("events").select("event_id", "user_id", "value").where("value is not null"), [F.desc("value"), F.col("event_id")], 5, 40)
    return rows.select("*", *[F.lit(v).alias(k) for k, v in about.items()])


@query("""SELECT user_id, event_type, ts, value, count(*) OVER (PARTITION BY user_id, event_type) AS total FROM events
WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31' AND event_type IN ('click', 'view')""")
def signal_history(t):
    """Q14, Q17: a lookback window by entity and category, with totals."""
    e = t("events").where((F.col("ts") >= at("2024-01-24")) & (F.col("ts") < at(NOW)) & F.col("event_type").isin("click", "view"))
    return e.select("user_id", "event_type", "ts", "value", F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type")).alias("total"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%0001%' OR c_mktsegment ILIKE '%mach%'")
def entity_search(t):
    """Q18, Q25: a text in any of several columns, in any case."""
    c = t("customer")
    return c.where(F.col("c_name").ilike("%0001%") | F.col("c_mktsegment").ilike("%mach%")).select("c_custkey", "c_name", "c_mktsegment")


@query("""SELECT doc_id, source, (position('idiot' IN lower(text)) > 0)::INT + (position('license' IN lower(text)) > 0)::INT AS hits FROM documents
WHERE position('idiot' IN lower(text)) > 0 OR position('license' IN lower(text)) > 0""")
def keyword_search(t):
    """Keywords in texts, in any case."""
    has = lambda w: F.lower("text").contains(w)
    return t("documents").where(has("idiot") | has("license")).select("doc_id", "source", (has("idiot").cast("int") + has("license").cast("int")).alias("hits"))


@query("""SELECT user_id, 'event' AS kind, ts AS at, event_type AS detail FROM events WHERE value > 200
UNION ALL SELECT o_custkey, 'order', o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 400000""")
def timeline(t):
    """One timeline out of two tables."""
    a = t("events").where("value > 200").select("user_id", F.lit("event").alias("kind"), F.col("ts").alias("at"), F.col("event_type").alias("detail"))
    b = t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("user_id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("detail"))
    return a.unionByName(b)


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events
WHERE coalesce(ts, TIMESTAMP '2024-01-01') BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY ALL""")
def payload_field(t):
    """A field of the JSON payload, over a range of times with a default."""
    e = t("events").where(F.coalesce("ts", at("2024-01-01")).between(at("2024-01-10"), at("2024-01-20")))
    return e.groupBy("event_type", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'purchase') AS purchase, avg(value) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id)
SELECT user_id, coalesce(purchase >= 60, false) OR (coalesce(click BETWEEN 30 AND 70, false) AND coalesce(error < 40, false)) AS fires FROM s
WHERE user_id NOT IN (3, 5) AND (user_id IN (7) OR regexp_matches(user_id::VARCHAR, '^(?:1|2)'))""")
def alert_rules(t):
    """Q28-Q30: a nested rule whose missing signals are false, behind gates of names."""
    s = t("events").groupBy("user_id").pivot("event_type", ["click", "purchase", "error"]).agg(F.avg("value"))
    rule = {"logic": "OR", "conditions": [{"signal": "purchase", "op": ">=", "value": 60}, {"logic": "AND", "conditions": [{"signal": "click", "op": "between", "value": [30, 70]}, {"signal": "error", "op": "<", "value": 40}]}]}
    name = F.col("user_id").cast("string")
    gated = s.where(filters.entity_gate(name, ["3", "5"], ["7"], "1|2"))
    return gated.select("user_id", filters.rule_tree(rule, {c: F.col(c) for c in ("click", "purchase", "error")}).alias("fires"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id")
def as_known_then(t):
    """Q31: what was known at a point in time."""
    return filters.as_known(t("events"), "ts", "2024-01-15").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


@query("""WITH a AS (SELECT doc_id, lower(text) AS x, date_diff('day', DATE '2023-12-31' + CAST(doc_id % 40 AS INT), DATE '2024-01-31') AS age, n_chars AS views FROM documents),
s AS (SELECT doc_id, least(1.5 * ((contains(x, 'the'))::INT + contains(x, 'with')::INT + contains(x, 'token')::INT), 4.0) + CASE WHEN age <= 1 THEN 2.0 WHEN age <= 7 THEN 1.0 ELSE 0.0 END + 1.0
  + CASE WHEN views >= 500 THEN 2.0 WHEN views >= 100 THEN 1.0 ELSE 0.0 END AS raw, contains(x, 'idiot') AS out_ FROM a)
SELECT doc_id, CASE WHEN out_ THEN 0.0 ELSE least(raw, 10.0) END AS score FROM s WHERE CASE WHEN out_ THEN 0.0 ELSE least(raw, 10.0) END >= 4""")
def article_filter(t):
    """A rule score with a threshold."""
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.date_add(F.lit("2023-12-31").cast("date"), (F.col("doc_id") % 40).cast("int")))
    score = filters.article_score(F.col("text"), ["the", "with", "token"], ["idiot"], age, F.lit(0.5), F.col("n_chars"))
    return t("documents").select("doc_id", score.cast("double").alias("score")).where("score >= 4")


@query("""SELECT user_id, event_type, ts, value FROM events e WHERE ts = (SELECT max(ts) FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type)""")
def latest_per_key(t):
    """The newest row of each key; ties stay."""
    return joins.latest(t("events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "ts", "value")


@query("""SELECT e.event_id, coalesce(a.n_name, b.n_name) AS home FROM events e LEFT JOIN nation a ON e.user_id = a.n_nationkey
LEFT JOIN (SELECT n_regionkey + 100 AS k, min(n_name) AS n_name FROM nation GROUP BY 1) b ON e.user_id = b.k""")
def either_key(t):
    """A lookup by one key or, failing that, by another."""
    n = t("nation").groupBy((F.col("n_regionkey") + 100).alias("k2")).agg(F.min("n_name").alias("home"))
    both = t("nation").select(F.col("n_nationkey").alias("k1"), F.lit(None).cast("int").alias("k2"), F.col("n_name").alias("home")).unionByName(n.select(F.lit(None).cast("int").alias("k1"), "k2", "home"))
    return joins.either_key(t("events").select("event_id", "user_id"), both, "user_id", "k1", "k2", "home").select("event_id", "home")


@query("""SELECT c_custkey, s.total FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) s ON c_custkey = o_custkey
ORDER BY s.total DESC NULLS LAST, c_custkey LIMIT 40""")
def top_with_missing(t):
    """All entities by score, those without one last."""
    s = t("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = t("customer")
    return c.join(s, c.c_custkey == s.o_custkey, "left").select("c_custkey", "total").orderBy(F.col("total").desc_nulls_last(), "c_custkey").limit(40)


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_final FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def semi_and_anti(t):
    """Existence and absence."""
    o, c = t("orders"), t("customer").select("c_custkey")
    rest = c.join(o.where("o_totalprice > 400000"), c.c_custkey == o.o_custkey, "left_anti")
    final = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit(True).alias("f")).distinct()
    return rest.join(final, rest.c_custkey == final.k, "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_final"))


@query("""SELECT c.event_id AS cause, e.event_id AS effect, epoch_us(e.ts) - epoch_us(c.ts) AS gap_us FROM events c JOIN events e ON c.user_id = e.user_id
AND ((c.event_type = 'signup' AND e.event_type = 'purchase') OR (c.event_type = 'click' AND e.event_type = 'error')) AND e.ts > c.ts AND e.ts <= c.ts + INTERVAL 2 DAY""")
def causal_pairs(t):
    """Causes and effects of one entity within two days, for given pairs of types."""
    spark = t("events").sparkSession
    kinds = spark.createDataFrame([("signup", "purchase"), ("click", "error")], "event_type_l string, event_type_r string")
    e = t("events").select("event_id", "user_id", "event_type", "ts")
    p = joins.pairs_within(e.where(F.col("event_type").isin("signup", "click")), e.where(F.col("event_type").isin("purchase", "error")), "user_id", "ts", 2)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return p.join(kinds, ["event_type_l", "event_type_r"]).select(F.col("event_id_l").alias("cause"), F.col("event_id_r").alias("effect"), (micros("ts_r") - micros("ts_l")).alias("gap_us"))


@query("""WITH d AS (SELECT o_custkey AS k, o_orderdate AS day, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL), u AS (SELECT DISTINCT o_custkey AS k, o_orderdate - INTERVAL 2 DAY AS day FROM orders WHERE o_orderstatus = 'F')
SELECT u.k, u.day, min_by(d.price, d.day) AS price, min(date_diff('day', u.day, d.day))::INT AS lag_days FROM u LEFT JOIN d ON d.k = u.k AND d.day >= u.day AND d.day <= u.day + INTERVAL 3 DAY GROUP BY ALL""")
def forward_as_of(t):
    """The first value at a time or up to three days later."""
    o = t("orders").withColumnRenamed("o_custkey", "k")
    d = o.groupBy("k", F.col("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    u = o.where("o_orderstatus = 'F'").select("k", (F.col("o_orderdate") - F.expr("interval 2 days")).alias("day")).distinct()
    return joins.first_after(u, d, "k", "day", "price", 3).select("k", "day", "price", "lag_days")


@query("""SELECT user_id, max_by(value, ts) AS now_value, max_by(value, ts) FILTER (ts <= TIMESTAMP '2024-01-20') AS then_value FROM events GROUP BY user_id""")
def nearest_before(t):
    """The score nearest to, but not after, a cutoff beside the newest one."""
    e = t("events")
    now = joins.value_before(e, ["user_id"], "ts", "value", at(NOW), "now_value")
    return now.join(joins.value_before(e, ["user_id"], "ts", "value", at("2024-01-20"), "then_value"), "user_id", "left")


@query("""WITH a AS (SELECT ts::DATE AS day, round(avg(value), 6) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT ts::DATE AS day, round(avg(value), 6) AS buys FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1)
SELECT day::VARCHAR AS day, clicks, buys FROM a JOIN b USING (day)""")
def aligned_days(t):
    """Two series on the days that both have."""
    day = F.to_date("ts").alias("day")
    a = t("events").where("event_type = 'click'").groupBy(day).agg(F.round(F.avg("value"), 6).alias("clicks"))
    b = t("events").where("event_type = 'purchase' and value > 60").groupBy(day).agg(F.round(F.avg("value"), 6).alias("buys"))
    return a.join(b, "day").withColumn("day", F.col("day").cast("string"))


@query("""WITH o AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE ts::DATE BETWEEN '2024-01-20' AND '2024-01-24' GROUP BY ALL), n AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE ts::DATE BETWEEN '2024-01-25' AND '2024-01-29' GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'gone' WHEN n.v - o.v > 5 THEN 'stronger' WHEN n.v - o.v < -5 THEN 'weaker' ELSE 'same' END AS change
FROM o FULL JOIN n USING (user_id, event_type)""")
def snapshot_diff(t):
    """What is new, gone, stronger or weaker between two snapshots."""
    part = lambda a, b: t("events").where(F.to_date("ts").between(a, b)).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return joins.snapshot_diff(part("2024-01-20", "2024-01-24"), part("2024-01-25", "2024-01-29"), ["user_id", "event_type"], "v", 5.0).select("user_id", "event_type", "change")


@query("""SELECT d.source, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, round(avg(CASE WHEN (d.n_chars > 600) = (l.quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0 GROUP BY d.source""")
def predictions_and_outcomes(t):
    """Forecasts joined with what came about."""
    j = t("documents").select("doc_id", "source", "n_chars").join(t("labels").where("toxic = 0"), "doc_id")
    right = F.when((F.col("n_chars") > 600) == (F.col("quality") == 1), 1.0).otherwise(0.0)
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg(right), 6).alias("accuracy"))


@query("""WITH m AS (SELECT p_brand AS bucket, p_partkey FROM part WHERE p_size > 10 UNION ALL SELECT p_type, p_partkey FROM part), s AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT bucket, count(*) AS members, count(q) AS covered, round(count(q) / count(*)::DOUBLE, 6) AS coverage, sum(q) AS quantity FROM m LEFT JOIN s ON l_partkey = p_partkey GROUP BY bucket""")
def buckets_many_to_many(t):
    """Members in several buckets, and how many of them have a signal."""
    p = t("part")
    m = p.where("p_size > 10").select(F.col("p_brand").alias("bucket"), "p_partkey").unionByName(p.select(F.col("p_type").alias("bucket"), "p_partkey"))
    s = t("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    j = m.join(s, m.p_partkey == s.l_partkey, "left").groupBy("bucket")
    return j.agg(F.count(F.lit(1)).alias("members"), F.count("q").alias("covered"), F.round(F.count("q") / F.count(F.lit(1)), 6).alias("coverage"), F.sum("q").alias("quantity"))


@query("""WITH a AS (SELECT user_id AS id, min(ts) AS first_seen, max(value) AS score FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id AS id, min(ts) AS first_seen, CASE WHEN min(value) > 65 THEN NULL ELSE min(value) END AS score FROM events WHERE event_type = 'error' AND value >= 60 GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.first_seen, b.first_seen) AS first_seen, coalesce(b.score, a.score) AS score FROM a FULL JOIN b ON a.id = b.id""")
def upserted(t):
    """Two stores merged, a null never replacing a value."""
    e = t("events")
    a = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("first_seen"), F.max("value").alias("score"))
    b = e.where("event_type = 'error' and value >= 60").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("first_seen"), F.when(F.min("value") <= 65, F.min("value")).alias("score"))
    return sinks.upsert(a, b, "id", keep_old=("first_seen",))


@query("""WITH w AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'NATION_' || (user_id % 30) WHEN 1 THEN 'R' || (user_id % 8) ELSE 'x' || user_id END AS name FROM events)
SELECT event_id, coalesce(n.n_nationkey, r.r_regionkey + 100)::BIGINT AS target, CASE WHEN n.n_nationkey IS NOT NULL THEN 'name' WHEN r.r_regionkey IS NOT NULL THEN 'alias' END AS matched_by
FROM w LEFT JOIN nation n ON w.name = n.n_name LEFT JOIN region r ON w.name = 'R' || r.r_regionkey""")
def resolution_ladder(t):
    """Staged lookups; the first that knows a name decides."""
    user = F.col("user_id")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("NATION_"), user % 30)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("R"), user % 8)).otherwise(F.concat(F.lit("x"), user))
    steps = [("name", t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("target"))), ("alias", t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("name"), (F.col("r_regionkey") + 100).cast("long").alias("target")))]
    return joins.ladder(t("events").select("event_id", name.alias("name")), "name", steps).select("event_id", "target", "matched_by")


@query("""SELECT event_type AS source, max(ts) AS newest, count(*) AS n_records, date_diff('day', max(ts)::DATE, DATE '2024-01-31')::INT AS age_days,
date_diff('day', max(ts)::DATE, DATE '2024-01-31') > CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 7 END AS is_stale FROM events GROUP BY 1""")
def source_freshness(t):
    """The newest record of each source and whether it is stale."""
    return tables.newest_per_source(t("events").withColumnRenamed("event_type", "source"), "source", "ts", NOW, {"click": 0, "view": 1})


@query("""SELECT origin, count(*) AS n, count(category) AS with_category, round(sum(amount), 2) AS amount FROM (
SELECT 'events' AS origin, user_id AS id, event_type AS category, NULL AS amount FROM events UNION ALL SELECT 'orders', o_custkey, NULL, o_totalprice FROM orders UNION ALL SELECT 'suppliers', s_suppkey, NULL, s_acctbal FROM supplier) GROUP BY 1""")
def united_sources(t):
    """Sources of differing shape in one table."""
    u = tables.union_sources({"events": t("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("category")), "orders": t("orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount")), "suppliers": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount"))})
    return u.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("category").alias("with_category"), F.round(F.sum("amount"), 2).alias("amount"))


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, ts::VARCHAR AS hit, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    '{"at":"' || ts::VARCHAR || '","event_id":' || event_id || ',"event_type":"' || event_type || '","value":'
      || CASE WHEN value IS NULL THEN 'null' WHEN round(value, 8) = floor(value) THEN floor(value)::BIGINT::VARCHAR ELSE round(value, 8)::VARCHAR END || '}' AS body
  FROM events),
r AS (
  SELECT user_id, k, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS entry_hash FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, r.entry_hash, sha256(r.entry_hash || e.body) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT e.user_id, event_id, hit AS at, event_type, value, prev_hash, entry_hash FROM e JOIN r USING (user_id, k)""")
def ledger_chain(t):
    """A hash chain over each user's events in order; each entry covers the one before."""
    e = t("events").select("user_id", "event_id", F.col("ts").cast("string").alias("at"), "event_type", "value")
    return sinks.hash_chain(e, "user_id", "event_id")


def flagship(spark, sf_dir):
    """Composite view of the entities: mentions, spread over types and newest score, by mean score."""
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("types"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", "ts").alias("newest")).orderBy(F.desc("mean"), "user_id")
