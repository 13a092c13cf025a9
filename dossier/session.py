"""Session defaults and the checks that decide when a table may be broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "dossier", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the workers of a session that was started elsewhere."""
    context = spark.sparkContext
    if getattr(context, "_dossier_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="dossier-pkg-"), "dossier.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._dossier_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A folder of our own is set only where a local session names none; on a cluster that is an error, since executors share no
    folder of the driver's machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set, and executors share no other folder")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="dossier-ckpt-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_within(df: DataFrame, limit: int) -> list | None:
    """Rows of ``df`` when there are at most ``limit`` of them, else None.

    Never reads more than ``limit + 1`` rows to the driver, so it is the size
    check that has to precede any use of a table as a broadcast variable.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, for a result used several times downstream.

    It is written to the shared folder and read back, so the planner knows its size and decides by it.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
