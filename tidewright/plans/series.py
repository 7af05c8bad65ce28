"""Time-series queries: events by day, orders by week."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins
from ..operators import statistics as st
from ..operators import timeseries as ts
from .registry import query

DAILY = "d AS (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY ALL)"
WEEKLY = "w AS (SELECT c_mktsegment AS seg, date_trunc('week', o_orderdate)::DATE AS wk, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def daily(t):
    return t("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"), F.count(F.lit(1)).alias("n"))


def weekly(t):
    o = t("orders").select("o_custkey", "o_orderdate", "o_totalprice").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("seg"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("wk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def text_day(df, *days):
    for d in days:
        df = df.withColumn(d, F.col(d).cast("string"))
    return df


@query(f"""WITH {WEEKLY.replace("w AS", "w0 AS", 1)}, w AS (SELECT seg, round(100.0 * (rank() OVER (PARTITION BY seg ORDER BY n) - 1) / count(*) OVER (PARTITION BY seg), 1) AS pn, round(100.0 * (rank() OVER (PARTITION BY seg ORDER BY total) - 1) / count(*) OVER (PARTITION BY seg), 1) AS pt, wk FROM w0)
SELECT seg, wk::VARCHAR AS wk, pn, pt, round(0.5 * pn + 0.5 * pt, 4) AS heat FROM w""")
def percentile_heat(t):
    """Share of weeks strictly below, and their blend."""
    w = weekly(t).select("seg", "wk", ts.percent_below("n", ["seg"]).alias("pn"), ts.percent_below("total", ["seg"]).alias("pt"))
    return text_day(w.withColumn("heat", F.round(0.5 * F.col("pn") + 0.5 * F.col("pt"), 4)), "wk")


@query("""WITH l AS (SELECT user_id, ts::DATE AS day, max_by(value, ts) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM l GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM s)
SELECT g.user_id, g.day::VARCHAR AS day, last_value(l.v IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day) AS value, l.v IS NULL AS filled FROM g LEFT JOIN l USING (user_id, day)""")
def daily_filled(t):
    """The last value of each day, carried over days without one."""
    return text_day(ts.daily(t("events"), ["user_id"], "ts", "value"), "day")


@query(f"""WITH {DAILY}, j AS (SELECT a.day, a.v AS x, b.v AS y FROM d a JOIN d b USING (day) WHERE a.event_type = 'click' AND b.event_type = 'purchase')
SELECT day::VARCHAR AS day, CASE WHEN count(*) OVER s >= 7 THEN round(corr(x, y) OVER s, 5) END AS r7, CASE WHEN count(*) OVER l >= 14 THEN round(corr(x, y) OVER l, 5) END AS r14 FROM j
WINDOW s AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), l AS (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""")
def rolling_correlation(t):
    """Correlation over the last week, and over the two weeks before the day."""
    d = daily(t)
    j = d.where("event_type = 'click'").select("day", F.col("v").alias("x")).join(d.where("event_type = 'purchase'").select("day", F.col("v").alias("y")), "day").withColumn("k", F.lit("click-purchase"))
    return text_day(j.select("day", F.round(ts.pearson("x", "y", ts.last_rows(["k"], "day", 7), 7), 5).alias("r7"), F.round(ts.pearson("x", "y", ts.last_rows(["k"], "day", 14, 1), 14), 5).alias("r14")), "day")


@query(f"""WITH {DAILY}, j AS (SELECT a.event_type AS lead, b.event_type AS follow, date_diff('day', a.day, b.day) AS lag, a.v AS x, b.v AS y FROM d a JOIN d b ON a.event_type < b.event_type AND abs(date_diff('day', a.day, b.day)) <= 7),
s AS (SELECT lead, follow, lag, corr(x, y) AS r, count(*) AS n FROM j GROUP BY ALL HAVING count(*) >= 10)
SELECT lead, follow, arg_max(lag, (round(abs(r), 6), -lag)) AS lag, round(arg_max(r, (round(abs(r), 6), -lag)), 5) AS r, arg_max(n, (round(abs(r), 6), -lag)) AS n FROM s GROUP BY ALL""")
def lead_lag(t):
    """The lag at which two series agree most."""
    d = daily(t)
    kinds = d.select(F.col("event_type").alias("lead")).distinct()
    pairs = kinds.join(kinds.withColumnRenamed("lead", "follow"), F.col("lead") < F.col("follow"))
    a = d.join(pairs, d.event_type == pairs.lead).select("lead", "follow", "day", "v")
    b = d.join(pairs, d.event_type == pairs.follow).select("lead", "follow", "day", "v")
    best = ts.best_lag(ts.lead_lag(a, b, ["lead", "follow"], "day", "v", range(-7, 8)), ["lead", "follow"])
    return best.withColumn("lag", F.col("lag").cast("long")).withColumn("r", F.round("r", 5))


@query(f"""WITH {DAILY}, c AS (SELECT *, v - lag(v) OVER w AS c, lag(v, 5) OVER w AS v5, lag(v, 10) OVER w AS v10 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
m AS (SELECT *, avg(v) OVER r7 AS m7, avg(v) OVER r14 AS m14, avg(greatest(c, 0)) OVER r14 AS up, avg(greatest(-c, 0)) OVER r14 AS down, count(c) OVER r14 AS nc, avg(v) OVER r20 AS mid, stddev_samp(v) OVER r20 AS sd, count(*) OVER r20 AS n20 FROM c
WINDOW r7 AS (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING), r14 AS (PARTITION BY event_type ORDER BY day ROWS 13 PRECEDING), r20 AS (PARTITION BY event_type ORDER BY day ROWS 19 PRECEDING))
SELECT event_type, day::VARCHAR AS day, round(m7, 5) AS sma7, round(m14, 5) AS sma14, m7 > m14 AND lag(m7 <= m14) OVER w AS golden, round(100 * (v - v5) / abs(v5), 4) AS roc5, round((v - v5) - (v5 - v10), 5) AS accel,
round(CASE WHEN nc < 14 THEN 50 WHEN down < 1e-12 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi, CASE WHEN n20 >= 20 THEN round(mid, 5) END AS mid, CASE WHEN n20 >= 20 THEN round((v - (mid - 2 * sd)) / (4 * sd), 4) END AS place
FROM m WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def technicals(t):
    """Means and crosses, rates of change, relative strength, bands."""
    k, w = ["event_type"], ts.by(["event_type"], "day")
    d = ts.bollinger(ts.rsi("v", k, "day")(daily(t)), "v", k, "day")
    d = d.withColumn("m7", ts.sma("v", k, "day", 7)).withColumn("m14", ts.sma("v", k, "day", 14))
    d = d.withColumn("golden", (F.col("m7") > F.col("m14")) & F.lag(F.col("m7") <= F.col("m14")).over(w))
    d = d.select("event_type", "day", F.round("m7", 5).alias("sma7"), F.round("m14", 5).alias("sma14"), "golden", F.round(ts.roc("v", k, "day", 5), 4).alias("roc5"), F.round(ts.acceleration("v", k, "day", 5), 5).alias("accel"), F.round("rsi", 4).alias("rsi"), F.round("mid", 5).alias("mid"), F.round("place", 4).alias("place"))
    return text_day(d, "day")


@query(f"""WITH {DAILY}, a AS (SELECT event_type, list(v ORDER BY day) AS vs FROM d GROUP BY 1), s AS (SELECT event_type, vs, list_sort(vs) AS so, len(vs) AS n FROM a),
c AS (SELECT event_type, n, list_transform(vs, lambda x: least(greatest(x, so[floor(n * 0.1)::INT + 1]), so[least(floor(n * 0.9)::INT, n - 1) + 1])) AS cl, vs FROM s)
SELECT event_type, n::INT AS n, round(list_reduce(vs, lambda p, x: 0.3 * x + 0.7 * p), 5) AS ewma, round(list_avg(cl), 5) AS clipped_mean FROM c""")
def smoothed_series(t):
    """Exponentially weighted mean and mean of clipped values."""
    d = daily(t)
    line = ts.ema(ts.placed(d, ["event_type"], "day"), ["event_type"], "v", 0.3, "ewma")
    last = line.groupBy("event_type").agg(F.count(F.lit(1)).cast("int").alias("n"), F.round(F.max_by("ewma", "_i"), 5).alias("ewma"))
    means = ts.clipped(d, ["event_type"], "v", 0.1, 0.9, "c").groupBy("event_type").agg(F.round(F.avg("c"), 5).alias("clipped_mean"))
    return last.join(means, "event_type")


@query(f"""WITH RECURSIVE {WEEKLY}, x AS (SELECT seg, total, row_number() OVER (PARTITION BY seg ORDER BY wk) AS i, avg(total) OVER (PARTITION BY seg ORDER BY wk ROWS 11 PRECEDING) AS m12, avg(total) OVER (PARTITION BY seg ORDER BY wk ROWS 25 PRECEDING) AS m26 FROM w),
e AS (SELECT seg, i, m12 AS fast, NULL::DOUBLE AS slow FROM x WHERE i = 12 UNION ALL
  SELECT x.seg, x.i, e.fast + 2 / 13.0::DOUBLE * (x.total - e.fast), CASE WHEN x.i = 26 THEN x.m26 ELSE e.slow + 2 / 27.0::DOUBLE * (x.total - e.slow) END FROM e JOIN x ON x.seg = e.seg AND x.i = e.i + 1),
l AS (SELECT seg, i, fast - slow AS v, avg(fast - slow) OVER (PARTITION BY seg ORDER BY i ROWS 8 PRECEDING) AS m9 FROM e WHERE i >= 26),
g AS (SELECT seg, i, m9 AS s FROM l WHERE i = 34 UNION ALL SELECT l.seg, l.i, g.s + 0.2::DOUBLE * (l.v - g.s) FROM g JOIN l ON l.seg = g.seg AND l.i = g.i + 1)
SELECT l.seg, round(max_by(l.v, l.i), 3) AS macd, round(max_by(g.s, l.i), 3) AS signal FROM l LEFT JOIN g ON g.seg = l.seg AND g.i = l.i GROUP BY 1""")
def macd(t):
    """Difference of two EMAs seeded with means, by week."""
    w = ts.placed(weekly(t), ["seg"], "wk")
    both = ts.ema(ts.ema(w, ["seg"], "total", 2 / 13, "fast", 12), ["seg"], "total", 2 / 27, "slow", 26)
    line = both.where("slow is not null").withColumn("_i", F.col("_i") - 25).withColumn("line", F.col("fast") - F.col("slow"))
    signal = ts.ema(line, ["seg"], "line", 0.2, "signal", 9)
    return signal.groupBy("seg").agg(F.round(F.max_by("line", "_i"), 3).alias("macd"), F.round(F.max_by("signal", "_i"), 3).alias("signal"))


@query("""SELECT o_custkey, round(sum(o_totalprice) FILTER (d < 180) / 180, 4) AS per_day, round(sum(o_totalprice) FILTER (d >= 180) / 180, 4) AS before, CASE WHEN coalesce(sum(o_totalprice) FILTER (d < 180), 0) > 1.2 * coalesce(sum(o_totalprice) FILTER (d >= 180), 0) THEN 'rising' WHEN coalesce(sum(o_totalprice) FILTER (d < 180), 0) < 0.8 * coalesce(sum(o_totalprice) FILTER (d >= 180), 0) THEN 'falling' ELSE 'steady' END AS trend
FROM (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS d FROM orders) WHERE d BETWEEN 0 AND 359 GROUP BY 1""")
def funding_momentum(t):
    """The last 180 days against the 180 before."""
    o = t("orders").withColumn("d", F.datediff(F.lit("2001-08-01").cast("date"), "o_orderdate")).where("d between 0 and 359")
    now, old = F.sum(F.when(F.col("d") < 180, F.col("o_totalprice"))), F.sum(F.when(F.col("d") >= 180, F.col("o_totalprice")))
    a, b = F.coalesce(now, F.lit(0)), F.coalesce(old, F.lit(0))
    return o.groupBy("o_custkey").agg(F.round(now / 180, 4).alias("per_day"), F.round(old / 180, 4).alias("before"), F.when(a > 1.2 * b, "rising").when(a < 0.8 * b, "falling").otherwise("steady").alias("trend"))


@query(f"""WITH {WEEKLY}, r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY wk DESC) AS k FROM w), b AS (SELECT seg, count(*) AS n, avg(n) AS mean, stddev_samp(n) AS sd, median(n) AS median, list_sort(list(n))[floor(count(*) * 0.1)::INT + 1] AS p10, list_sort(list(n))[floor(count(*) * 0.9)::INT + 1] AS p90, regr_slope(n, -k) AS slope, max_by(n, wk) AS latest FROM r WHERE k <= 26 GROUP BY 1)
SELECT seg, n, round(mean, 5) AS mean, round(sd, 5) AS sd, median, p10, p90, round(slope, 5) AS slope, latest, round((latest - mean) / sd, 5) AS z FROM b""")
def baselines(t):
    """Mean, spread, quantiles, slope and z-score of the last 26 weeks."""
    b = ts.baseline(weekly(t).select("seg", "wk", F.col("n").alias("x")), ["seg"], "wk", "x", 26)
    return b.select("seg", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), "median", "p10", "p90", F.round("slope", 5).alias("slope"), "latest", F.round("z", 5).alias("z"))


@query("""WITH d AS (SELECT user_id, date_diff('day', ts::DATE, DATE '2024-01-31') AS age FROM events), c AS (SELECT user_id, count(*) FILTER (age <= 7) AS recent, count(*) FILTER (age BETWEEN 8 AND 35) AS older FROM d GROUP BY 1)
SELECT user_id, recent, older, round(recent / greatest(1.0, older / 4.0), 5) AS velocity FROM c""")
def velocity(t):
    """Mentions of a week against the weekly mean of four weeks before."""
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    c = t("events").groupBy("user_id").agg(F.count_if(age <= 7).alias("recent"), F.count_if(age.between(8, 35)).alias("older"))
    return c.withColumn("velocity", F.round(F.col("recent") / F.greatest(F.lit(1.0), F.col("older") / 4.0), 5))


@query(f"""WITH {WEEKLY}, b AS (SELECT *, avg(n) OVER p AS base_n, avg(total) OVER p AS base_total, count(*) OVER p AS k FROM w WINDOW p AS (PARTITION BY seg ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
s AS (SELECT seg, wk, n, k, n >= 1.3 * base_n AS spike, total >= 1.2 * base_total AS surge, base_n FROM b)
SELECT seg, wk::VARCHAR AS wk, CASE WHEN k = 0 THEN 'new' WHEN spike AND surge THEN 'combo' WHEN spike THEN 'velocity_spike' WHEN surge THEN 'score_surge' END AS signal,
round(CASE WHEN k > 0 THEN least(1.0, (0.3 * least(n / base_n / 3, 1) + 0.3 * spike::INT + 0.2 * surge::INT + 0.2 * k / 4.0) * CASE WHEN spike AND surge THEN 1.2 ELSE 1.0 END) ELSE 0.5 END, 5) AS confidence FROM s WHERE k = 0 OR spike OR surge""")
def trend_signals(t):
    """Weeks that stand out against the four before."""
    p = ts.last_rows(["seg"], "wk", 4, 1)
    b = weekly(t).withColumns({"base_n": F.avg("n").over(p), "base_total": F.avg("total").over(p), "k": F.count(F.lit(1)).over(p)})
    spike, surge = F.col("n") >= 1.3 * F.col("base_n"), F.col("total") >= 1.2 * F.col("base_total")
    s = b.withColumns({"spike": spike, "surge": surge}).where("k = 0 or spike or surge")
    kind = F.when(F.col("k") == 0, "new").when(F.col("spike") & F.col("surge"), "combo").when(F.col("spike"), "velocity_spike").when(F.col("surge"), "score_surge")
    raw = 0.3 * F.least(F.try_divide(F.col("n").cast("double"), F.col("base_n")) / 3, F.lit(1.0)) + 0.3 * F.col("spike").cast("int") + 0.2 * F.col("surge").cast("int") + 0.2 * F.col("k") / 4.0
    conf = F.when(F.col("k") > 0, F.least(F.lit(1.0), raw * F.when(F.col("spike") & F.col("surge"), 1.2).otherwise(1.0))).otherwise(0.5)
    return text_day(s.select("seg", "wk", kind.alias("signal"), F.round(conf, 5).alias("confidence")), "wk")


@query(f"""WITH {DAILY}, j AS (SELECT a.event_type AS ea, b.event_type AS eb, a.day, a.v AS x, b.v AS y FROM d a JOIN d b USING (day) WHERE a.event_type < b.event_type),
r AS (SELECT ea, eb, day, CASE WHEN count(*) OVER s >= 7 THEN corr(x, y) OVER s END AS short, CASE WHEN count(*) OVER l >= 20 THEN corr(x, y) OVER l END AS long FROM j WINDOW s AS (PARTITION BY ea, eb ORDER BY day ROWS 6 PRECEDING), l AS (PARTITION BY ea, eb ORDER BY day ROWS 19 PRECEDING)),
p AS (SELECT *, avg(short) OVER (PARTITION BY ea, eb ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prev FROM r)
SELECT ea, eb, day::VARCHAR AS day, round(short, 5) AS short, round(long, 5) AS long, CASE WHEN abs(short - long) >= 0.5 THEN 'critical' WHEN abs(short - long) >= 0.3 THEN 'warning' ELSE 'none' END AS alert,
CASE WHEN prev IS NULL THEN NULL WHEN abs(prev) >= 0.5 AND abs(short) < 0.2 THEN 'breakdown' WHEN abs(prev) < 0.2 AND abs(short) >= 0.5 THEN 'emergence' WHEN prev * short < 0 AND abs(short - prev) >= 0.5 THEN 'reversal' END AS regime FROM p WHERE long IS NOT NULL""")
def correlation_regimes(t):
    """Short against long windows, and changes against the days before."""
    d = daily(t)
    a, b = d.select(F.col("event_type").alias("ea"), "day", F.col("v").alias("x")), d.select(F.col("event_type").alias("eb"), "day", F.col("v").alias("y"))
    k = ["ea", "eb"]
    r = a.join(b, "day").where("ea < eb")
    r = r.withColumn("short", ts.pearson("x", "y", ts.last_rows(k, "day", 7), 7)).withColumn("long", ts.pearson("x", "y", ts.last_rows(k, "day", 20), 20)).withColumn("prev", F.avg("short").over(ts.last_rows(k, "day", 3, 1)))
    gap, s, p = F.abs(F.col("short") - F.col("long")), F.col("short"), F.col("prev")
    alert = F.when(gap >= 0.5, "critical").when(gap >= 0.3, "warning").otherwise("none")
    regime = F.when((F.abs(p) >= 0.5) & (F.abs(s) < 0.2), "breakdown").when((F.abs(p) < 0.2) & (F.abs(s) >= 0.5), "emergence").when((p * s < 0) & (F.abs(s - p) >= 0.5), "reversal")
    return text_day(r.where("long is not null").select("ea", "eb", "day", F.round(s, 5).alias("short"), F.round("long", 5).alias("long"), alert.alias("alert"), regime.alias("regime")), "day")


@query(f"""WITH {DAILY}, g AS (SELECT *, v > 50 AS good FROM d), i AS (SELECT *, sum((NOT good)::INT) OVER (PARTITION BY event_type ORDER BY day) AS grp FROM g)
SELECT event_type, day::VARCHAR AS day, sum(good::INT) OVER (PARTITION BY event_type, grp ORDER BY day)::BIGINT AS days_in_row,
coalesce(v <= lag(v) OVER w AND lag(v) OVER w <= lag(v, 2) OVER w AND lag(v, 2) OVER w <= lag(v, 3) OVER w, false) AS falling FROM i WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def persistence(t):
    """Days in a row above a level, and four that fall."""
    w = ts.by(["event_type"], "day")
    v = lambda k: F.lag("v", k).over(w) if k else F.col("v")
    d = joins.islands(daily(t), ["event_type"], "day", F.col("v") > 50, "days_in_row")
    falling = (v(0) <= v(1)) & (v(1) <= v(2)) & (v(2) <= v(3))
    return text_day(d.select("event_type", "day", "days_in_row", F.coalesce(falling, F.lit(False)).alias("falling")), "day")


@query("""WITH u AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark), p AS (SELECT b.item_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE AS s FROM u a JOIN u b ON a.item_id < b.item_id)
SELECT u.item_id, round(1 - coalesce(sum(s), 0) / greatest(count(s), 1), 5) AS novelty FROM u LEFT JOIN p USING (item_id) GROUP BY 1""")
def novelty(t):
    """One less the mean overlap with all items before; the sum of overlaps needs only pairs that share a word."""
    u = t("benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    e = u.select("item_id", F.size("w").alias("n"), F.explode("w").alias("x"))
    p = e.join(e.toDF("later", "m", "x"), "x").where("item_id < later").groupBy("item_id", "later", "n", "m").agg(F.count(F.lit(1)).alias("both"))
    sums = p.groupBy("later").agg(F.sum(F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("s"))
    place = u.select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("before"))  # benchmark items are few
    return place.join(sums, place.item_id == sums.later, "left").select("item_id", F.round(1 - F.coalesce("s", F.lit(0.0)) / F.greatest("before", F.lit(1)), 5).alias("novelty"))


@query("""WITH r AS (SELECT d.doc_id, l.quality, d.n_chars, row_number() OVER (ORDER BY d.doc_id) - 1 AS p, count(*) OVER () AS n FROM documents d JOIN labels l USING (doc_id)),
f AS (SELECT *, floor(n * 0.7)::INT AS first, greatest(1, (n - floor(n * 0.7)::INT) // 5) AS step FROM r), x AS (SELECT *, unnest(range(0, 5)) AS fold FROM f),
y AS (SELECT fold, p < first + fold * step AS train, quality, n_chars FROM x WHERE p < first + (fold + 1) * step),
m AS (SELECT fold, avg(n_chars) FILTER (train AND quality = 1) AS g, avg(n_chars) FILTER (train AND quality = 0) AS b FROM y GROUP BY 1)
SELECT fold::INT AS fold, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test, round(avg(CASE WHEN (abs(n_chars - g) <= abs(n_chars - b)) = (quality = 1) THEN 1.0 ELSE 0.0 END) FILTER (NOT train), 6) AS accuracy FROM y JOIN m USING (fold) GROUP BY 1""")
def walk_forward(t):
    """Expanding folds; a rule fitted on what came before is scored on what follows."""
    d = t("documents").select("doc_id", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id")
    y = st.walk_forward(d, ["doc_id"], d.count())
    train, q, c = F.col("part") == "train", F.col("quality"), F.col("n_chars")
    m = y.groupBy("fold").agg(F.avg(F.when(train & (q == 1), c)).alias("g"), F.avg(F.when(train & (q == 0), c)).alias("b"))
    hit = F.when((F.abs(c - F.col("g")) <= F.abs(c - F.col("b"))) == (q == 1), 1.0).otherwise(0.0)
    return y.join(m, "fold").groupBy("fold").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.round(F.avg(F.when(~train, hit)), 6).alias("accuracy"))
