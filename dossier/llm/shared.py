"""What the operators of this package share: stored tables, streams of rows, words and linked groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import ship_package

#: Rows that a task turns into Python objects at a time.
SLICE = 512
#: Bits of a filter for each key, of any filter at most (8 MB), and of one of its blocks.
FILTER_BITS, FILTER_MOST, FILTER_BLOCK = 16, 1 << 26, 1 << 15


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set, and executors share no other folder")
        root = tempfile.mkdtemp(prefix="dossier-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage to repeat, and a size that the planner knows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, so that Python objects of long texts never pile up."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front where ``df`` has such a column already (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def screened(rows: DataFrame, value: Column, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``value`` may be among the keys (column ``key`` of ``keys``, of the same type), and those whose value is surely not.

    The keys' hashes are broadcast as bitmaps, two to four bytes a key and never more than 8 MB. With more keys than that serves well, more rows of the first part have no key;
    an exact join of that part settles it either way. The second part goes on without a shuffle, whatever the number of keys.
    """
    wanted = min(max(keys.count() * FILTER_BITS, FILTER_BLOCK), FILTER_MOST)
    bits = 1 << (wanted - 1).bit_length()
    at, block, bitmap = (fresh_name(rows, n) for n in ("_at", "_block", "_bitmap"))
    places = keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias(at))
    blocks = places.groupBy(F.shiftright(at, FILTER_BLOCK.bit_length() - 1).alias(block)).agg(F.bitmap_construct_agg(F.col(at) % FILTER_BLOCK).alias(bitmap))
    known = rows.withColumn(at, F.pmod(F.xxhash64(value), F.lit(bits))).join(
        F.broadcast(stored(blocks, "filter")), F.shiftright(at, FILTER_BLOCK.bit_length() - 1) == F.col(block), "left")
    byte = F.substring(F.col(bitmap), F.shiftright(F.col(at) % FILTER_BLOCK, 3).cast("int") + 1, F.lit(1))
    held = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast(`{at}` % 8 as int))")) != 0
    maybe = F.coalesce(held, F.lit(False))
    return known.where(maybe).drop(at, block, bitmap), known.where(~maybe).drop(at, block, bitmap)


def content_of(text: str) -> Column:
    """SHA-256 of a text, 32 bytes; a null text counts as an empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


# The word class of the contracts is every code point but ASCII other than digits and letters, letters in lower case.
_ASCII_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, as UTF-8. A null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_ASCII_WORDS).split() if text else []


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a``-``b`` as as few links as keep every group whole: each member to the smallest of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = np.minimum(new, new[root])
        while (jumped := new[new] < new).any():
            new[jumped] = new[new[jumped]]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns ``a`` and ``b``): root is the smallest node of its group.

    Rounds of large-star and small-star steps: every step hangs the neighbours of a node on the smallest of them, so hubs stay
    aggregates and joins, and the number of rounds follows the logarithm of the longest chain. Every round is stored.
    """

    def both(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def lowest(neighbours: DataFrame) -> DataFrame:
        return neighbours.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(edges)
    while before[0]:
        around = both(edges)
        large = around.where("b > a").join(lowest(around), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        below = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = lowest(below)
        small = below.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
