"""Projection and predicates: conditions from JSON, searches, rules and points in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}


def named(df: DataFrame, name: str) -> Column:
    """A column that df has; anything else is an error, never SQL text."""
    if name not in df.columns:
        raise ValueError(f"unknown column {name}; there are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def compare(c: Column, op: str, value: object = None) -> Column:
    """One predicate. Text matching with `ilike` and `contains` ignores case."""
    op = op.lower()
    simple = {"=": c.__eq__, "!=": c.__ne__, "<>": c.__ne__, ">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__, "like": c.like, "ilike": c.ilike}
    if op in simple:
        return simple[op](value)
    if op in ("in", "not in"):
        return c.isin(*value) if op == "in" else ~c.isin(*value)
    if op in ("is null", "is not null"):
        return c.isNull() if op == "is null" else c.isNotNull()
    if op in ("between", "not between"):
        low, high = value
        return c.between(low, high) if op == "between" else ~c.between(low, high)
    if op == "contains":
        return F.lower(c).contains(str(value).lower())
    raise ValueError(f"unknown operator {op}")


def condition(df: DataFrame, tree: dict | list) -> Column:
    """A Column from nested conditions: {"field", "op", "value"}, {"and": [...]}, {"or": [...]}, {"not": ...}; a list means and."""
    if isinstance(tree, list):
        tree = {"and": tree}
    if "field" in tree:
        return compare(named(df, tree["field"]), tree["op"], tree.get("value"))
    if "not" in tree:
        return ~condition(df, tree["not"])
    for key, join in (("and", Column.__and__), ("or", Column.__or__)):
        if key in tree:
            parts = [condition(df, t) for t in tree[key]]
            return reduce(join, parts) if parts else F.lit(key == "and")
    raise ValueError(f"no condition in {sorted(tree)}")


def boolean_query(df: DataFrame, q: dict) -> DataFrame:
    """select, where, group_by, aggregate, order_by, limit (100, at most 10000) and offset of a query given as JSON."""
    if q.get("where"):
        df = df.where(condition(df, q["where"]))
    if q.get("aggregate"):
        aggs = [AGGREGATES[a["fn"].lower()](F.lit(1) if a.get("field", "*") == "*" else named(df, a["field"])).alias(a.get("as") or f"{a['fn']}_{a.get('field', 'all')}".lower()) for a in q["aggregate"]]
        df = df.groupBy(*[named(df, c) for c in q.get("group_by", [])]).agg(*aggs)
        if q.get("having"):
            df = df.where(condition(df, q["having"]))
    elif q.get("select"):
        df = df.select(*[named(df, s if isinstance(s, str) else s["field"]).alias(s if isinstance(s, str) else s.get("as", s["field"])) for s in q["select"]])
    if q.get("order_by"):
        df = df.orderBy(*[(named(df, o["field"]).desc_nulls_last() if o.get("desc") else named(df, o["field"]).asc_nulls_last()) for o in q["order_by"]])
    return df.offset(q.get("offset", 0)).limit(min(q.get("limit", 100), 10_000))


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text, in any case, in any of the columns."""
    return df.where(reduce(Column.__or__, [F.lower(named(df, c)).contains(text.lower()) for c in columns]))


def rule_tree(rule: dict, signals: dict[str, Column]) -> Column:
    """An alert rule as a Column: a missing signal and an empty group are false, never null."""
    if "conditions" in rule:
        parts = [rule_tree(r, signals) for r in rule["conditions"]]
        if not parts:
            return F.lit(False)
        return reduce(Column.__and__ if rule.get("logic", "AND").upper() == "AND" else Column.__or__, parts)
    if rule["signal"] not in signals:
        return F.lit(False)
    return F.coalesce(compare(signals[rule["signal"]], rule["op"], rule["value"]), F.lit(False))


def entity_gate(name: Column, blocked: list[str], allowed: list[str], pattern: str | None = None) -> Column:
    """Blocked names never pass; then allowed ones do; then those that the pattern matches from their start; all if neither is given."""
    free = F.lit(not allowed and not pattern)
    return ~name.isin(*blocked) & (name.isin(*allowed) | (name.rlike(f"^(?:{pattern})") if pattern else F.lit(False)) | free)


def as_known(df: DataFrame, at: str, when: str) -> DataFrame:
    """What was known at a point in time: no row after it."""
    return df.where(F.col(at) <= F.lit(when).cast("timestamp_ntz"))


def article_score(text: Column, include: list[str], exclude: list[str], age_days: Column, trust: Column, views: Column) -> Column:
    """0 to 10: keywords, freshness, trust in the source and views; an excluded word gives 0."""
    low = F.lower(text)
    hits = reduce(Column.__add__, [low.contains(w.lower()).cast("int") for w in include])
    raw = F.least(hits * 1.5, F.lit(4.0)) + F.when(age_days <= 1, 2.0).when(age_days <= 7, 1.0).otherwise(0.0) + 2 * F.coalesce(trust, F.lit(0.5)) + F.when(views >= 500, 2.0).when(views >= 100, 1.0).otherwise(0.0)
    return F.when(reduce(Column.__or__, [low.contains(w.lower()) for w in exclude], F.lit(False)), 0.0).otherwise(F.least(raw, F.lit(10.0)))
