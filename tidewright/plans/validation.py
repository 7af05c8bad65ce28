"""Statistics, calibration and validation queries. A document's forecast is a function of its length; the label is what came about."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators import statistics as st
from ..sources.tables import settled
from .registry import query

FORECAST = """f AS (SELECT doc_id, source, lang, least(0.99, greatest(0.01, round(ln(n_chars + 1) / 10.0, 3))) AS p, quality AS hit FROM documents JOIN labels USING (doc_id))"""


def forecasts(t):
    d = t("documents").select("doc_id", "source", "lang", "n_chars").join(t("labels").select("doc_id", F.col("quality").alias("hit")), "doc_id")
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.round(F.log(F.col("n_chars") + 1) / 10.0, 3)))
    return d.select("doc_id", "source", "lang", p.alias("p"), "hit")


@query(f"""WITH {FORECAST}, g AS (SELECT source, count(*) AS n, sum(hit) AS k FROM f GROUP BY 1)
SELECT source, n, round(k / n::DOUBLE, 6) AS accuracy, round((k / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low,
round((k / n::DOUBLE + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM g""")
def wilson_intervals(t):
    """Accuracy with Wilson's interval."""
    g = forecasts(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {FORECAST} SELECT lang, count(*) AS n, round(avg(pow(p - hit, 2)), 6) AS brier, round(avg(p) - avg(hit), 6) AS overconfidence, round(avg((p > 0.5) = (hit = 1)::BOOL), 6) AS accuracy,
round(count(*) FILTER (p > 0.5 AND hit = 1) / nullif(count(*) FILTER (p > 0.5), 0)::DOUBLE, 6) AS "precision", round(count(*) FILTER (p > 0.5 AND hit = 1) / nullif(count(*) FILTER (hit = 1), 0)::DOUBLE, 6) AS recall FROM f GROUP BY 1""".replace("avg((p > 0.5) = (hit = 1)::BOOL)", "avg(CASE WHEN (p > 0.5) = (hit = 1) THEN 1.0 ELSE 0.0 END)"))
def calibration_report(t):
    """Brier score, overconfidence, accuracy, precision and recall."""
    p, h = F.col("p"), F.col("hit")
    both = F.count_if((p > 0.5) & (h == 1))
    return forecasts(t).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(st.brier(p, h), 6).alias("brier"), F.round(F.avg(p) - F.avg(h), 6).alias("overconfidence"), F.round(F.avg(F.when((p > 0.5) == (h == 1), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.try_divide(both, F.count_if(p > 0.5)), 6).alias("precision"), F.round(F.try_divide(both, F.count_if(h == 1)), 6).alias("recall"))


@query(f"""WITH {FORECAST}, b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS forecast, avg(hit) AS observed FROM f GROUP BY 1)
SELECT r.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(forecast, 6) AS forecast, round(observed, 6) AS observed FROM range(10) r(bin) LEFT JOIN b USING (bin)""")
def reliability_curve(t):
    """Equal-width bins, empty ones included."""
    r = st.reliability(forecasts(t), "p", "hit", 10)
    return r.select("bin", "n", F.round("forecast", 6).alias("forecast"), F.round("observed", 6).alias("observed"))


@query(f"""WITH {FORECAST}, r AS (SELECT p, hit, row_number() OVER (ORDER BY p, doc_id) - 1 AS k, count(*) OVER () AS n FROM f) SELECT least(k // (n // 8), 7)::INT AS bin, count(*) AS n, round(avg(p), 6) AS forecast, round(avg(hit), 6) AS observed FROM r GROUP BY 1""")
def equal_count_bins(t):
    """Bins of equal count, the last taking the rest."""
    f = forecasts(t)
    n = f.count()
    k = joins.numbered(f, ["p", "doc_id"], "k")
    return k.groupBy(F.least(F.floor(F.col("k") / max(1, n // 8)), F.lit(7)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("forecast"), F.round(F.avg("hit"), 6).alias("observed"))


@query(f"""WITH {FORECAST}, b AS (SELECT lang, CASE WHEN p < 0.3 THEN 0 WHEN p < 0.5 THEN 1 WHEN p < 0.7 THEN 2 WHEN p < 0.85 THEN 3 ELSE 4 END AS bin, count(*) AS n, avg(p) AS fc, avg(hit) AS ob FROM f GROUP BY ALL)
SELECT lang, round(sum(n * abs(fc - ob)) / sum(n), 6) AS ece, round(least(greatest(sum(n * ob / fc) / sum(n), 0.5), 1.5), 6) AS factor, count(*) AS bins FROM b GROUP BY 1""")
def calibration_errors(t):
    """Expected calibration error over fixed edges, and the factor that corrects it."""
    f = forecasts(t)
    b = f.groupBy("lang", st.edge_bin(F.col("p"), [0, 0.3, 0.5, 0.7, 0.85, 1.0]).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("fc"), F.avg("hit").alias("ob"))
    ece = F.try_divide(F.sum(F.col("n") * F.abs(F.col("fc") - F.col("ob"))), F.sum("n"))
    return b.groupBy("lang").agg(F.round(ece, 6).alias("ece"), F.round(st.calibration_factor(F.col("n"), F.col("fc"), F.col("ob")), 6).alias("factor"), F.count(F.lit(1)).alias("bins"))


@query(f"""WITH {FORECAST} SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, round(avg(CASE WHEN (p > 0.5) = (hit = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f GROUP BY GROUPING SETS ((source), (lang), ()) HAVING count(*) >= 5""")
def accuracy_breakdown(t):
    """Accuracy by each dimension and overall."""
    f = forecasts(t).withColumn("ok", F.when((F.col("p") > 0.5) == (F.col("hit") == 1), 1.0).otherwise(0.0)).select("ok", F.explode(F.array(F.struct("source", F.lit("*").alias("lang")), F.struct(F.lit("*").alias("source"), "lang"), F.struct(F.lit("*").alias("source"), F.lit("*").alias("lang")))).alias("g"))
    return f.groupBy("g.source", "g.lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("accuracy")).where("n >= 5")


@query(r"""WITH o AS (SELECT strftime(o_orderdate, '%Y-W%W') AS wk, avg(CASE WHEN (o_totalprice > 250000) = (o_orderstatus = 'F') THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM orders GROUP BY 1) SELECT wk, n, round(a, 6) AS accuracy FROM o""")
def weekly_accuracy(t):
    """Accuracy by week, weeks starting on Monday and the days before the first one being week 0."""
    d = F.col("o_orderdate")
    number = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    wk = F.concat(F.year(d), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))
    hit = F.when((F.col("o_totalprice") > 250000) == (F.col("o_orderstatus") == "F"), 1.0).otherwise(0.0)
    return t("orders").groupBy(wk.alias("wk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


@query("""WITH a AS (SELECT o_custkey, sum(o_totalprice) FILTER (year(o_orderdate) = 1999) AS old, sum(o_totalprice) FILTER (year(o_orderdate) = 2000) AS new FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN 100 * (new - old) / abs(old) >= 15 THEN 'rising' WHEN 100 * (new - old) / abs(old) <= -15 THEN 'falling' WHEN 100 * (new - old) / abs(old) IS NOT NULL THEN 'flat' END AS outcome FROM a""")
def outcomes(t):
    """Change between two windows as an outcome."""
    from ..functions.scores import outcome

    y = F.year("o_orderdate")
    part = lambda k: F.sum(F.when(y == k, F.col("o_totalprice")))
    a = t("orders").groupBy("o_custkey").agg(part(1999).alias("old"), part(2000).alias("new"))
    return a.select("o_custkey", outcome(F.col("new"), F.col("old"), 15).alias("outcome"))


@query("""WITH w(event_type, w) AS (VALUES ('purchase', 1.0), ('signup', 0.8), ('click', 0.5), ('view', 0.3), ('error', 0.9))
SELECT user_id, round(least(greatest(0.5 + 0.3 * sum(CASE event_type WHEN 'error' THEN -1.0 ELSE 1.0 END * least(value / 100, 1.0) * w) / sum(w), 0.05), 0.95), 6) AS belief, count(*) AS n FROM events JOIN w USING (event_type) GROUP BY 1""")
def beliefs(t):
    """Evidence with direction, saturated strength and weight moves a prior."""
    w = t("events").sparkSession.createDataFrame([("purchase", 1.0), ("signup", 0.8), ("click", 0.5), ("view", 0.3), ("error", 0.9)], "event_type string, w double")
    e = t("events").join(F.broadcast(w), "event_type")  # w: five rows
    s = F.when(F.col("event_type") == "error", -1.0).otherwise(1.0) * F.least(F.col("value") / 100, F.lit(1.0))
    return st.belief(e.withColumn("s", s), "user_id", "s", "w", 0.5, 0.3).withColumn("belief", F.round("belief", 6))


@query("""WITH s AS (SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span, stddev_pop(value) AS sd, avg(value) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1)
SELECT user_id, kinds, CASE WHEN span <= 7 THEN 1.0 WHEN span <= 14 THEN 0.7 ELSE 0.4 END AS alignment, round(kinds / 5.0 * least(1.0, n / 10.0) * (1 + 0.1 * (kinds - 1)), 6) AS validation, round(mean - 1.96 * sd / 2, 5) AS low, round(mean + 1.96 * sd / 2, 5) AS high FROM s""")
def signal_validation(t):
    """Coverage, strength and variety of sources, agreement in time, and an interval."""
    e = t("events").where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))
    s = e.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"), F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("span"), F.stddev_pop("value").alias("sd"), F.avg("value").alias("mean"))
    span = F.when(F.col("span") <= 7, 1.0).when(F.col("span") <= 14, 0.7).otherwise(0.4)
    v = F.col("kinds") / 5.0 * F.least(F.lit(1.0), F.col("n") / 10.0) * (1 + 0.1 * (F.col("kinds") - 1))
    half = 1.96 * F.col("sd") / 2
    return s.select("user_id", "kinds", span.alias("alignment"), F.round(v, 6).alias("validation"), F.round(F.col("mean") - half, 5).alias("low"), F.round(F.col("mean") + half, 5).alias("high"))


@query("""SELECT md5(event_type || '|' || (value * 100)::BIGINT) AS claim, count(DISTINCT user_id) AS sources, count(*) AS n, CASE WHEN count(DISTINCT user_id) >= 3 THEN 'confirmed' WHEN count(DISTINCT user_id) = 2 THEN 'likely' ELSE 'single' END AS status FROM events GROUP BY 1""")
def claims(t):
    """Claims by hash, and how many sources make them."""
    claim = F.md5(F.concat_ws("|", "event_type", F.round(F.col("value") * 100).cast("long").cast("string")))
    g = t("events").groupBy(claim.alias("claim")).agg(F.count_distinct("user_id").alias("sources"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("status", F.when(F.col("sources") >= 3, "confirmed").when(F.col("sources") == 2, "likely").otherwise("single"))


@query("""
WITH d AS (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL),
m AS (SELECT a.event_type AS a, b.event_type AS b, corr(a.v, b.v) AS r, count(*) AS n FROM d a JOIN d b ON a.day = b.day AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 10),
i AS (
  SELECT a, b, sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 - pow(r * k / 2000, 2), (n - 4) / 2.0)) * abs(r) / 6000
    / exp(lgamma(0.5::DOUBLE) + lgamma((n - 2) / 2.0::DOUBLE) - lgamma((n - 1) / 2.0::DOUBLE)) AS half
  FROM m, range(0, 2001) t(k) GROUP BY a, b, r, n),
p AS (SELECT m.*, 1 - 2 * half AS p, count(*) OVER () AS tests, atanh(r) AS f, 1.96 / sqrt(n - 3) AS h FROM m JOIN i USING (a, b))
SELECT a, b, n, round(r, 5) AS r, round(p, 6) AS p, round(least(p * tests, 1.0), 6) AS p_corrected, least(p * tests, 1.0) < 0.05 AS significant, round(tanh(f - h), 5) AS low, round(tanh(f + h), 5) AS high FROM p""")
def correlation_tests(t):
    """Correlation of daily series with p-values, Bonferroni's correction and Fisher's interval."""
    from .series import daily
    from ..operators.graphs import correlation_matrix

    m = settled(correlation_matrix(daily(t), "event_type", "day", "v", 10).withColumn("p", st.t_p_value(F.col("r"), F.col("n"))), "tests")
    q, ok = st.bonferroni(F.col("p"), m.agg(F.count("p")).scalar())
    low, high = st.fisher_interval(F.col("r"), F.col("n"))
    rounded = [F.round("r", 5).alias("r"), F.round("p", 6).alias("p"), F.round(q, 6).alias("p_corrected"), ok.alias("significant"), F.round(low, 5).alias("low"), F.round(high, 5).alias("high")]
    return m.select("a", "b", "n", *rounded)


@query(f"""
WITH x0 AS (SELECT event_type, value, draw, (event_id::UBIGINT * 2654435761 + draw::UBIGINT * 2246822519) % 4294967296 AS x FROM events, range(1, 1001) t(draw) WHERE value IS NOT NULL),
x1 AS (SELECT * REPLACE ((xor(x, x >> 16) * 2246822507) % 4294967296 AS x) FROM x0), x2 AS (SELECT * REPLACE ((xor(x, x >> 13) * 3266489909) % 4294967296 AS x) FROM x1),
u AS (SELECT event_type, value, draw, xor(x, x >> 16) / 4294967296.0::DOUBLE AS u FROM x2),
w AS (SELECT event_type, draw, value, {" + ".join(f"(u >= {e!r})::INT" for e in st.POISSON_EDGES)} AS w FROM u),
m AS (SELECT event_type, draw, sum(w * value) / sum(w) AS m FROM w GROUP BY ALL)
SELECT event_type, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high FROM m GROUP BY 1""")
def bootstrap_intervals(t):
    """Intervals of means from 1,000 draws."""
    got = st.bootstrap_mean(t("events"), ["event_type"], "value", "event_id")
    return got.select("event_type", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS statistic FROM r WHERE k >= n // 10 AND k < n - n // 10 GROUP BY 1""")
def own_statistic(t):
    """A statistic of one's own, here the mean without the lowest and highest tenth; ranks come from a range sort of all rows, sums from parts."""
    e = joins.numbered(t("events").select("event_type", "value", "event_id").where("value is not null"), ["event_type", "value", "event_id"], "k")
    ends = e.groupBy("event_type").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    cut = F.floor(F.col("n") / 10)
    inner = e.join(ends, "event_type").where((F.col("k") - F.col("first") >= cut) & (F.col("k") - F.col("first") < F.col("n") - cut))
    s = st.by_parts(inner, ["event_type"], "value", lambda v: [v.sum(), len(v)], 2)
    return s.select("event_type", F.round(F.col("s0") / F.col("s1"), 6).alias("statistic"))
