"""Token counts behind a cache of content digests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.ledger import Ledger
from dossier.llm.shared import over_batches, slices
from dossier.llm.vocabulary import encoder, file_digest

COUNT_COLUMNS = "n_tokens long"


def whole(text: Column) -> Column:
    """Normal form of a content for exact counts: the text itself, a null being empty."""
    return F.coalesce(text, F.lit(""))


def _counted(batches: Iterator[pa.RecordBatch], path: str, version: str) -> Iterator[pa.RecordBatch]:
    count = encoder(path).count
    for batch in slices(batches):
        n = [count(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = 1024, key: str = "doc_id", text: str = "text", normal=whole) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; counts come from the cache at ``cache_path``.

    A content is known by the SHA-256 of its normal form, a tokenizer by that of its vocabulary file. Contents without a stored count are
    encoded once each, appended to the cache, and joined to all rows of that content. A later call finds them there and encodes nothing.

    A null text is empty (0 bytes, 0 tokens). Repeated rows give repeated rows, null keys stay, no rows give none; other columns play no
    part. ``normal`` maps the text column to the form that is counted, and must name the same content for equal results.
    """
    cache = Ledger(docs.sparkSession, cache_path, COUNT_COLUMNS)
    version = file_digest(tokenizer)
    rows = docs.select(F.col(key).alias("doc_id"), normal(F.col(text)).alias("content")).withColumn("digest", F.sha2("content", 256))
    missing = cache.unseen(rows.select("digest", "content"), version)
    cache.append(over_batches(missing, partial(_counted, path=tokenizer, version=version), cache.schema))
    known = cache.rows(version).select("digest", "n_tokens")
    sized = rows.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return sized.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
