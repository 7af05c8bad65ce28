"""Registered queries over the given tables, each with DuckDB SQL where SQL can express it."""

from . import aggregates, assessments, content, feeds, reads, scoring, series, signals, stories, streams, validation
from .registry import ORACLE_SQL, QUERIES
from .reads import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "assessments", "content", "feeds", "flagship", "reads", "scoring", "series", "signals", "stories", "streams", "validation"]
