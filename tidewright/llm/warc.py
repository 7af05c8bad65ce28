"""WARC revisits: "not modified" records take their body from the latest earlier full response.

An as-of join by canonical URL. Captures are cut into spans of time; each (url, span) keeps its last full
response, a window over spans carries it forward, and a window inside the span refines it. So a URL with a
third of all captures is dealt over as many tasks as its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, settle, table

#: Headers that a 304 response may renew; all others stay as they were stored.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not choose a page.
TRACKING = "(?:utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Scheme, www., m., default port, fragment, tracking parameters and a trailing slash go; the host is lower-cased. Null or '' for no URL."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^(?:www|m)\\.|:(?:80|443)$", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, f"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "\\?&+", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+(\\?|$)", "$1"))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers (map of lower-case names), those of RENEWED replaced by what the 304 sent."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))), allowed)


def resolve_revisits(captures: DataFrame, span_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows of captures with status 304, each with the full response that it repeats.

    captures: record_id, url, at (long time), status (int), headers (map, lower-case names), body_id; other
    columns are ignored. Returns record_id, source_id (latest earlier 200 capture of the canonical URL, ties
    by the larger record_id; null if none), outcome and headers: `merged` if ETags agree, or, where either
    has none, Last-Modified agree; `changed` if they differ; `unproved` without a common validator; `orphan`
    without a source. headers and body_id are null unless merged. Captures of null URL or time are orphans.
    """
    c = captures.select("record_id", canonical_url(F.col("url")).alias("key"), "at", "status", "headers", "body_id")
    seen = c.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, ((seen.high or 0) - (seen.low or 0) + 1) * span_rows // max(1, seen.n))
    known = c.where("key is not null and at is not null")
    known = known.withColumn("span", F.floor((F.col("at") - F.lit(seen.low or 0)) / width).cast("long"))
    full = F.when(F.col("status") == 200, F.struct("at", "record_id", "headers", "body_id"))
    order = [F.col("at"), (F.col("status") == 200).cast("int"), F.col("record_id")]  # a 200 at the same time comes after a 304: it is not earlier
    last_of = known.where("status = 200").groupBy("key", "span").agg(F.max_by(F.struct("at", "record_id", "headers", "body_id"), F.struct("at", "record_id")).alias("last"))
    spans = known.select("key", "span").distinct().join(last_of, ["key", "span"], "left")
    carried = spans.select("key", "span", F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("key", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = known.withColumn("own", F.last(full, ignorenulls=True).over(inside)).where("status = 304").join(carried, ["key", "span"])
    found = found.withColumn("source", F.coalesce("own", "carried"))
    etag, stamp = (F.col("headers")[k] for k in ("etag", "last-modified"))
    etag0, stamp0 = (F.col("source.headers")[k] for k in ("etag", "last-modified"))
    outcome = (
        F.when(F.col("source").isNull(), "orphan")
        .when(etag.isNotNull() & etag0.isNotNull(), F.when(etag == etag0, "merged").otherwise("changed"))
        .when(stamp.isNotNull() & stamp0.isNotNull(), F.when(stamp == stamp0, "merged").otherwise("changed"))
        .otherwise("unproved")
    )
    found = found.withColumn("outcome", outcome)
    good = F.col("outcome") == "merged"
    out = found.select("record_id", F.col("source.record_id").alias("source_id"), "outcome", F.when(good, merge_headers(F.col("source.headers"), F.col("headers"))).alias("headers"), F.when(good, F.col("source.body_id")).alias("body_id"))
    lost = c.where("status = 304 and (key is null or at is null)").select("record_id", F.lit(None).cast("long").alias("source_id"), F.lit("orphan").alias("outcome"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast(captures.schema["body_id"].dataType).alias("body_id"))
    return out.unionByName(lost)


def captures_of(pages: DataFrame) -> DataFrame:
    """Crawl captures that pages (page_id, url, html) stand for.

    Each page gives a full response at 10 * page_id and a later 304, whose validators come from a hash of the
    page: most repeat the response's ETag, some send another or none, some only Last-Modified. Null html
    gives a response with an empty body.
    """
    body = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    draw = F.substring(body, 1, 1)
    day = F.concat(F.lit("day-"), F.substring(body, 2, 2))
    p = pages.select("page_id", "url", body.alias("body"), draw.alias("draw"), day.alias("day"))
    put = lambda **x: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in x]), F.array(*x.values())), lambda _, v: v.isNotNull())
    stored = put(etag=F.when(F.col("draw") != "f", F.col("body")), last_modified=F.col("day"), content_type=F.lit("text/html"), set_cookie=F.concat(F.lit("s="), F.col("draw")), date=F.concat(F.lit("t"), F.col("page_id")))
    fresh = put(
        etag=F.when(F.col("draw") < "b", F.col("body")).when(F.col("draw") == "b", F.lit("other")), last_modified=F.when(F.col("draw") > "c", F.col("day")),
        content_type=F.lit("text/plain"), set_cookie=F.lit("s=new"), date=F.concat(F.lit("r"), F.col("page_id")),
    )
    first = p.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("at"), F.lit(200).alias("status"), stored.alias("headers"), F.col("body").alias("body_id"))
    again = p.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + F.ascii("draw") % 7 * 1000).alias("at"), F.lit(304).alias("status"), fresh.alias("headers"), F.lit(None).cast("string").alias("body_id"))
    return first.unionByName(again)


def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve_revisits(settle(captures_of(table(spark, sf_dir, "pages")), "captures"))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(":"), e.value))), "\n")
    return got.select("record_id", "source_id", "outcome", lines.alias("header_lines"), "body_id")


ORACLE = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) body FROM pages),
d AS (SELECT *, substr(body, 1, 1) draw, concat('day-', substr(body, 2, 2)) AS day_of FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') u FROM d),
h AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^(?:www|m)\.|:(?:80|443)$', '', 'g') host,
  regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g') rest FROM u),
k AS (SELECT *, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS key FROM h),
full_ AS (SELECT key, page_id * 2 record_id, page_id * 10 AS at, CASE WHEN draw <> 'f' THEN body END etag, day_of stamp, draw, body, page_id FROM k WHERE key IS NOT NULL),
again AS (SELECT key, page_id * 2 + 1 record_id, page_id * 10 + ascii(draw) % 7 * 1000 AS at,
  CASE WHEN draw < 'b' THEN body WHEN draw = 'b' THEN 'other' END etag, CASE WHEN draw > 'c' THEN day_of END stamp, page_id FROM k),
j AS (SELECT a.record_id, a.etag, a.stamp, a.page_id, max_by(f, (f.at, f.record_id)) f
  FROM again a LEFT JOIN full_ f ON a.key = f.key AND f.at < a.at GROUP BY ALL),
o AS (SELECT *, CASE WHEN f.record_id IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN etag = f.etag THEN 'merged' ELSE 'changed' END
  WHEN stamp IS NOT NULL AND f.stamp IS NOT NULL THEN CASE WHEN stamp = f.stamp THEN 'merged' ELSE 'changed' END ELSE 'unproved' END outcome FROM j)
SELECT record_id, f.record_id source_id, outcome,
  CASE WHEN outcome = 'merged' THEN concat_ws(chr(10), 'content-type:text/html', 'date:r' || page_id, 'etag:' || coalesce(etag, f.etag), 'last-modified:' || coalesce(stamp, f.stamp), 'set-cookie:s=' || f.draw) END header_lines,
  CASE WHEN outcome = 'merged' THEN f.body END body_id
FROM o
"""
