"""Query log as an append stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dossier.sources.sinks import query_log


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def start_log(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append cleaned log rows exactly once; the checkpoint carries the progress over restarts."""
    return query_log(rows).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
