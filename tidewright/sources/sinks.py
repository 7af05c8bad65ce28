"""Writing: exports, partitioned snapshots, upserts, canonical JSON and hash chains."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, kind: str = "parquet", compression: str | None = None) -> None:
    """Write csv (with header), json or parquet files."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def streamed(df: DataFrame) -> Iterator[str]:
    """Rows as JSON lines, a partition at a time."""
    for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        yield r.j


def snapshot(df: DataFrame, path: str, by: str) -> None:
    """Overwrite just the partitions of `by` that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, dict]:
    """One page (numbers from 1) under a total order, and the counts that describe it."""
    total = df.count()
    pages = max(1, math.ceil(total / size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), {"total": total, "total_pages": pages, "has_next": number < pages, "has_prev": number > 1}


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key. A new value wins unless it is null; columns of keep_old stay if they have a value."""
    o, n = old.alias("o"), new.alias("n")
    cols = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        cols.append((F.coalesce(a, b) if c in keep_old or c == key else F.coalesce(b, a)).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def _canonical(x: object) -> object:
    if isinstance(x, float):
        if math.isnan(x) or math.isinf(x):
            raise ValueError("NaN and infinity have no canonical form")
        x = round(x, 8)
        return int(x) if x == int(x) else x
    if isinstance(x, datetime):
        return x.replace(microsecond=0).isoformat() + ("Z" if x.tzinfo is None else "")
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, dict):
        return {str(k): _canonical(v) for k, v in x.items()}
    return [_canonical(v) for v in x] if isinstance(x, (list, tuple)) else x


def canonical_json(x: object) -> str:
    """Sorted keys, no spaces, floats of eight digits, whole floats as integers, times in UTC seconds."""
    return json.dumps(_canonical(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def hash_chain(df: DataFrame, ledger: str, order: str) -> DataFrame:
    """Entries of each ledger with the hash of the entry before and their own, which covers it.

    A ledger is one sequence by nature: one task reads it in order, a batch at a time, and carries only the last hash.
    """
    fields = [c for c in df.columns if c != ledger]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields] + ["prev_hash string", "entry_hash string"])

    def fold(batches):
        now, last = None, ""
        for pdf in batches:
            prev, own = [], []
            for key, r in zip(pdf[ledger].tolist(), pdf[fields].to_dict("records"), strict=True):
                if key != now or not last:
                    now, last = key, "0" * 64
                prev.append(last)
                last = hashlib.sha256((last + canonical_json(r)).encode()).hexdigest()
                own.append(last)
            yield pdf.assign(prev_hash=prev, entry_hash=own)

    return df.repartition(ledger).sortWithinPartitions(ledger, order).mapInPandas(fold, schema)
