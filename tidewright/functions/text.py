"""Text and URL expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of company names, query parameters that only track, words without content.
SUFFIXES = ("inc", "corp", "corporation", "ltd", "limited", "llc", "gmbh", "co", "company", "plc", "sa", "ag")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid", "mc_cid", "mc_eid")
STOP_WORDS = ("the", "and", "for", "are", "was", "were", "with", "that", "this", "from", "have", "has", "had", "not", "but", "they", "his", "her", "its", "you", "will", "would", "can", "could", "about", "into", "than", "then", "them", "these", "those", "been", "being", "who", "what", "which", "when", "where", "how", "all", "any", "each", "more", "most", "other", "some", "such", "only", "own", "same", "too", "very")


def entity_id(name: Column) -> Column:
    """Lower case, company suffixes gone, other characters as single hyphens."""
    low = F.regexp_replace(F.lower(F.trim(name)), rf"[\s,]+(?:{'|'.join(SUFFIXES)})\.?$", "")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def host(url: Column) -> Column:
    """Host without www., 'unknown' if there is none."""
    h = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(F.coalesce(h, F.lit("")) == "", "unknown").otherwise(h)


def canonical(url: Column) -> Column:
    """Host and path in lower case without fragment, tracking parameters and trailing slash; other parameters stay in order."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://", ""), r"^www\.", "")
    path, query = F.regexp_extract(bare, r"^[^?]*", 0), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).isin(*TRACKING)), "&")
    return F.concat(F.regexp_replace(path, "/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def words(text: Column, least: int = 3) -> Column:
    """Lower-cased runs of a-z and 0-9 of some length that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def kind_of(name: Column, kinds: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first kind that has a part of the name, whatever its case; the default for names of none and for null."""
    out = F.lit(default)
    for kind, parts in reversed(list(kinds.items())):
        out = F.when(reduce(Column.__or__, [F.contains(F.lower(name), F.lit(p)) for p in parts]), kind).otherwise(out)
    return out


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\n", title, body), 256)


def fingerprint(*parts: Column) -> Column:
    """MD5 of the parts, trimmed and in lower case, joined by bars; nulls are empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts]))


def amount(text: Column) -> Column:
    """The first dollar amount with its unit, as a number; null if there is none."""
    pattern = r"(?i)\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand|bn|m|b|k)?\b"
    number, unit = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ""), F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.when(unit.isin("billion", "bn", "b"), 1e9).when(unit.isin("million", "m"), 1e6).when(unit.isin("thousand", "k"), 1e3).otherwise(1.0)
    return F.when(number != "", number.try_cast("double") * scale)


def funding(text: Column) -> Column:
    """A struct of amount_usd, stage (the first that is named, else unknown) and lead_investor (capitalised words after `led by`, else null)."""
    stage = F.regexp_extract(F.lower(text), "pre-seed|seed|series [a-e]|growth", 0)
    lead = F.regexp_extract(text, r"(?i:led by)\s+((?:[A-Z][A-Za-z]*)(?:\s+[A-Z][A-Za-z]*)*)", 1)
    stage = F.when(F.coalesce(stage, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(stage, "[ -]", "_"))
    return F.struct(amount(text).alias("amount_usd"), stage.alias("stage"), F.when(lead != "", lead).alias("lead_investor"))


def first_date(*texts: Column) -> Column:
    """The first text that is a date: ISO, year/month/day or day.month.year."""
    formats = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for t in texts for f in formats])


def citation(text: Column) -> Column:
    """A struct of source, day and number from `source:YYYY-MM-DD#number`; null if it has another form."""
    pattern = r"^([A-Za-z0-9_-]+):(\d{4}-\d{2}-\d{2})#(\d+)$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("source"), F.regexp_extract(text, pattern, 2).cast("date").alias("day"), F.regexp_extract(text, pattern, 3).cast("long").alias("number")))
