"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.sources.spread import spread_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a session that sets ``attestra.spread`` gets that many partitions of it."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("attestra.spread", None)
    return frame if spread is None else frame.repartition(int(spread))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work on each text alone: dealt over tasks where the files have few parts."""
    return spread_texts(table(spark, sf_dir, "documents"), "doc_id")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, for queries that write files and read them again."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/attestra-checks-{uuid.uuid4().hex}"
