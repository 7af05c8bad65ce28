"""A training corpus from documents: toxicity, near duplicates, benchmark leaks, mixing, shards.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to
the shared folder and reads again as the docs of the next stage. All but the last return the columns of documents.
A document without doc_id passes the filtering stages unless its own text is toxic, since no decision names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import settle, table
from tidewright.llm.decontamination import leaks
from tidewright.llm.mixing import mixed
from tidewright.llm.near_dup import near_duplicates
from tidewright.llm.sharding import shard_documents
from tidewright.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds toxic; it is fitted on the labels of those at hand."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; rows that repeat a doc_id stay together."""
    drop = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    drop = settle(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that expected tokens meet the margins of source, language and topic."""
    drop = mixed(docs).where("not sampled").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts each document into one of 40 shards."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: SQL cannot express the fitted classifier of the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
