"""Registered queries and, where SQL can say the same, the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from dossier.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# Tables with heavy text work per row, and the key that spreads them.
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


class Tables:
    """Lazy access to the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df, _TEXT_TABLES[name]) if name in _TEXT_TABLES else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when a table is stored as fewer pieces than there are cores.

    A large table has more splits than cores and is read as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with its oracle when there is one."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


FAMILIES = ("retrieval", "documents", "matching", "terms", "outline", "items", "evaluation", "pipelines")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"dossier.catalog.{family}")
