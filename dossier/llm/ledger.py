"""Tables that remember work by content: what was done once for a digest and a version is not done again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Rows keyed by (digest, version) in a folder of Parquet batches.

    An append is one write into a folder of its own, which counts once its ``_SUCCESS`` file is there; rows of the same key from two
    writers that ran at the same time are equal, and readers keep one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"digest string, version string, {schema}"

    def rows(self, version: str) -> DataFrame:
        """All rows of a version, one a digest. A ledger that was never written to has none."""
        batches = self._finished()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(*batches).where(F.col("version") == version)
        return found if len(batches) == 1 else found.dropDuplicates(["digest"])

    def append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def _finished(self) -> list[str]:
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(status.getPath().getParent().toString() for status in found or [])

    def unseen(self, contents: DataFrame, version: str) -> DataFrame:
        """``digest, content`` of ``contents``, each digest once, that this version has no row for.

        Copies fold before the shuffle, so a content that a third of all rows share reaches its task once from every other task.
        """
        once = contents.groupBy("digest").agg(F.first("content").alias("content"))
        return once.join(self.rows(version).select("digest"), "digest", "left_anti")
