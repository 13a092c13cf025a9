"""Writers: idempotent chunk replacement, logs, exports, dead letters, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import sanitize_for_storage
from dossier.session import checkpoint

BUCKETS = 512


def replaced(current: DataFrame, fresh: DataFrame, items: DataFrame, key: str = "parent_id") -> DataFrame:
    """Table after replacing all rows of ``items``: old rows of other items plus the new rows.

    An item without new rows ends up with none, as after delete-then-insert.
    """
    return current.join(items.select(key).distinct(), key, "left_anti").unionByName(fresh)


def write_chunks(spark: SparkSession, path: str, fresh: DataFrame, items: DataFrame, key: str = "parent_id", buckets: int = BUCKETS) -> None:
    """Replace the chunks of ``items`` in a table partitioned by key bucket.

    Only buckets that hold a replaced item are rewritten, so a rerun gives the same table. New rows are written before buckets
    that are left without any go; large buckets are written by several tasks.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = items.select(bucket.alias("bucket")).distinct()
    fresh = fresh.withColumn("bucket", bucket)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    rows, empty = fresh, None
    if exists:
        current = spark.read.schema(fresh.schema).parquet(path).join(touched, "bucket", "left_semi")
        # cut the lineage first: the buckets being read are the ones being written
        rows = checkpoint(replaced(current.select(fresh.columns), fresh, items, key))
        empty = touched.join(rows.select("bucket").distinct(), "bucket", "left_anti")
    (
        rows.hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
    for row in empty.toLocalIterator() if empty is not None else ():  # at most one entry per bucket
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={row['bucket']}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_terms(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose Chinese side is filled and not in the dictionary yet."""
    known = existing.where(F.col("zh").isNotNull()).select("zh").distinct()
    return candidates.where(F.coalesce("zh", F.lit("")) != "").join(known, "zh", "left_anti")


def updated_keywords(units: DataFrame, changes: DataFrame) -> DataFrame:
    """Unit map with new extended keywords, matched null-safely on (agency, unit, keywords)."""
    c = changes.select(*[F.col(k).alias(f"__{k}") for k in ("agency", "unit", "keywords")], F.col("extended").alias("__new"))
    same = (
        units["agency"].eqNullSafe(c["__agency"]) & units["unit"].eqNullSafe(c["__unit"]) & units["keywords"].eqNullSafe(c["__keywords"])
    )
    joined = units.join(c, same, "left")
    return joined.withColumn("extended", F.coalesce("__new", "extended")).drop("__agency", "__unit", "__keywords", "__new")


# Header of the term export.
TERM_COLUMNS = {"zh": "中文字詞", "en": "英文字詞", "count": "出現頻率", "units": "負責單位", "sources": "來源檔案"}


def term_export(terms: DataFrame) -> DataFrame:
    """Export rows: units joined by 、 and sources by comma, fixed header."""
    flat = terms.withColumns({"units": F.array_join("units", "、"), "sources": F.array_join("sources", ", ")})
    return flat.select(*[F.col(k).alias(v) for k, v in TERM_COLUMNS.items()])


def write_terms_csv(terms: DataFrame, path: str) -> bool:
    """UTF-8 CSV with a byte-order mark in front of the header of every part; no file for no terms."""
    if terms.isEmpty():
        return False
    out = term_export(terms)
    first = out.columns[0]
    out.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return True


def json_map_text(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON line per entry; the driver never holds the map."""
    return pairs.select(F.to_json(F.create_map(key, value)).alias("value"))


def write_json_map(pairs: DataFrame, key: str, value: str, path: str) -> None:
    json_map_text(pairs, key, value).write.mode("overwrite").text(path)


def json_object_lines(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Lines, in order of the key, that are one JSON object together; of several values of a key the largest stays. All lines are in one partition."""
    once = pairs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.max(F.col(value).cast("string")).alias("v"))
    entries = once.withColumn("e", F.to_json(F.create_map("k", F.col("v")), {"ignoreNullFields": "false"})).select("k", F.expr("substring(e, 2, length(e) - 2)").alias("entry"))

    def punctuated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A line behind: the last entry has no comma."""
        held, mark = "{", ""
        for batch in batches:
            lines = []
            for text in filter(None, batch.column(0).to_pylist()):
                lines.append(held + mark)
                held, mark = text, ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([held, "}"], pa.string())], ["value"])

    # a row without an entry, so that no entries are an object too
    always = pairs.sparkSession.range(1).select(F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("entry"))
    return entries.union(always).orderBy("k").coalesce(1).select("entry").mapInArrow(punctuated, "value string")


def write_json_object(pairs: DataFrame, key: str, value: str, path: str) -> None:
    """The map as one JSON object in one file, for readers that load it whole; one task streams the lines, sorted by many."""
    json_object_lines(pairs, key, value).write.mode("overwrite").text(path)


def dead_letters(df: DataFrame, stage: str, payload: str, error: Column, keys: Column, include_raw: bool = False, raw_limit: int | None = None) -> DataFrame:
    """Failed units of work as review records; the payload only as a hash unless asked for, then whole or up to ``raw_limit`` characters."""
    has = F.coalesce(payload, F.lit("")) != ""
    out = df.select(
        F.lit("needs_review").alias("status"), F.lit(stage).alias("stage"), "document_id", "unit_index", "total_units",
        error.alias("error_message"), keys.alias("candidate_keys"),
        F.when(has, F.sha2(F.col(payload), 256)).alias("raw_payload_sha256"),
        F.when(has & F.lit(include_raw), F.col(payload) if raw_limit is None else F.left(F.col(payload), F.lit(raw_limit))).alias("raw_payload"),
    )
    return out


def write_dead_letters(records: DataFrame, path: str, enabled: bool = True) -> bool:
    """Append records as JSON lines with sorted keys and a UTC stamp; off means no file."""
    if not enabled:
        return False
    stamped = records.withColumn("timestamp", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    stamped.select(*sorted(stamped.columns)).write.mode("append").json(path)
    return True


# Text columns of the query log that are cleaned before storing.
LOG_TEXTS = (
    "question", "translation", "agencies", "units", "enriched_query", "raw_context", "knowledge_context",
    "dictionary_xml", "prompt", "output", "english", "chinese", "error",
)


def query_log(rows: DataFrame) -> DataFrame:
    """Log rows ready to append: control characters out, id and time filled in."""
    clean = rows.withColumns({c: F.when(F.col(c).isNotNull(), sanitize_for_storage(F.col(c))) for c in LOG_TEXTS if c in rows.columns})
    defaults = {}
    if "log_id" not in rows.columns:
        defaults["log_id"] = F.uuid()
    if "created_at" not in rows.columns:
        defaults["created_at"] = F.current_timestamp()
    return clean.withColumns(defaults) if defaults else clean


def append_query_log(rows: DataFrame, path: str) -> str | None:
    """Append; what went wrong comes back as text, so that an unavailable store does not break an answer and is still seen."""
    try:
        query_log(rows).write.mode("append").parquet(path)
        return None
    except Exception as failure:  # noqa: BLE001
        return f"{type(failure).__name__}: {failure}"


def write_pages(pages: DataFrame, path: str) -> None:
    """Page images of converted files, partitioned by the head of the content hash."""
    pages.withColumn("prefix", F.left("file_md5", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(path)


def write_report(report: DataFrame, path: str, min_recall: float) -> int:
    """Write the evaluation report as JSON; 0 when every case reaches ``min_recall``, else 1."""
    report.write.mode("overwrite").json(path)
    return 0 if report.where(~(F.col("recall") >= min_recall)).isEmpty() else 1
