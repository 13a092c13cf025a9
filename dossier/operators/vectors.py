"""Exact cosine nearest neighbours for a batch of queries.

Every task keeps only its own best k rows per query while it streams Arrow batches, so
the shuffle carries at most queries x k x tasks rows however large the vector table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Queries of one broadcast, read by the driver one block at a time; more queries take more passes over the vectors. A block holds no more components and
# leads to no more rows of a task than these.
QUERIES_PER_PASS, COMPONENTS, KEPT = 16_384, 2**21, 2**19
# Rows and queries whose cosines a task makes at a time, small enough for a core's cache; rows of the first such block; cosines that are made anew at a time.
ROWS, QUERIES, FIRST, EXACT = 2_048, 512, 512, 2**14
# Rows of a batch that a task hands on.
OUT = 50_000
# Distances are compared after rounding, so equal vectors tie exactly on every machine.
DIGITS = 9


def cosine_distance(a, b):
    """1 - cosine of two array columns, in double precision, as a JVM expression."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64, without going through Python objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Nearest:
    """The k nearest rows so far of every query: flat arrays of query, distance and row, and the rows they name.

    Cosines in single precision, less than ``slack`` off, say which rows can be among the k nearest; only these get their distance in double precision.
    """

    def __init__(self, unit: np.ndarray, k: int, pk: str) -> None:
        self.unit, self.single, self.k, self.pk = unit, unit.astype(np.float32), k, pk
        self.query, self.distance, self.row = np.array([], np.int64), np.array([], np.float64), np.array([], np.int64)
        self.rows: pa.Table | None = None
        self.bound = np.full(len(unit), np.inf)
        self.least = np.full(len(unit), -np.inf, np.float32)
        self.slack = (unit.shape[1] + 8) * 2.0**-23 + 10.0**(1 - DIGITS)
        self.most = max(2 * len(unit) * k, 2**16)

    def add(self, data: np.ndarray, rows: pa.Table) -> None:
        """Rows of a batch, with their vectors."""
        norm = np.linalg.norm(data, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = data / norm[:, None]
        usable = np.flatnonzero(np.isfinite(unit).all(axis=1))
        data, norm, unit = data[usable], norm[usable], unit[usable].astype(np.float32)
        new: list[tuple] = []
        n = start = 0
        while start < len(unit):
            stop = start + (FIRST if self.rows is None and not start else ROWS)
            part = unit[start:stop]
            for at in range(0, len(self.single), QUERIES):
                cosine = part @ self.single[at:at + QUERIES].T
                least = self.least[at:at + QUERIES]
                if len(part) > self.k and np.isneginf(least).any():
                    floor = np.partition(np.ascontiguousarray(cosine.T), len(part) - self.k, axis=1)[:, len(part) - self.k]
                    least = np.maximum(least, floor - np.float32(2 * self.slack))
                row, query = np.divmod(np.flatnonzero(cosine >= least), cosine.shape[1])
                for i in range(0, len(row), EXACT):
                    r, q = start + row[i:i + EXACT], at + query[i:i + EXACT]
                    distance = np.round(1.0 - np.einsum("ij,ij->i", data[r], self.unit[q]) / norm[r], DIGITS)
                    near = distance <= self.bound[q]
                    new.append((q[near], distance[near], usable[r[near]]))
                    n += len(new[-1][0])
                if len(self.query) + n > self.most:
                    self._take(new, rows)
                    new, n = [], 0
                    self._cut()
            start = stop
        self._take(new, rows)

    def _take(self, new: list[tuple], rows: pa.Table) -> None:
        if not new:
            return
        query, distance, row = (np.concatenate(x) for x in zip(*new))
        used, at = np.unique(row, return_inverse=True)
        first = 0 if self.rows is None else self.rows.num_rows
        taken = rows.take(used)
        self.rows = taken if self.rows is None else pa.concat_tables([self.rows, taken])
        self.query, self.distance = np.concatenate([self.query, query]), np.concatenate([self.distance, distance])
        self.row = np.concatenate([self.row, first + at])

    def _cut(self) -> None:
        order = np.lexsort((self.distance, self.query))
        query, distance = self.query[order], self.distance[order]
        place = np.arange(len(order)) - np.searchsorted(query, query, side="left")
        last = place == self.k - 1
        self.bound[query[last]] = distance[last]
        ends = distance == self.bound[query]
        crowded = np.zeros(len(self.bound), bool)
        crowded[query[ends & (place >= self.k)]] = True
        ends &= crowded[query]
        if ends.any():
            # more rows at the distance of the k-th than there is room for: the smaller keys stay
            tied = order[ends]
            used, at = np.unique(self.row[tied], return_inverse=True)
            names = np.empty(len(used), np.int64)
            names[pc.sort_indices(self.rows.take(used), sort_keys=[(self.pk, "ascending")]).to_numpy()] = np.arange(len(used))
            order[ends] = tied[np.lexsort((names[at], self.query[tied]))]
        keep = order[place < self.k]
        self.query, self.distance = self.query[keep], self.distance[keep]
        used, self.row = np.unique(self.row[keep], return_inverse=True)
        self.rows = self.rows.take(used).combine_chunks()
        self.least = (1.0 - self.bound - self.slack).astype(np.float32)

    def best(self) -> tuple[np.ndarray, pa.Table]:
        """Queries, and the rows they have, with the distance."""
        self._cut()
        return self.query, self.rows.take(self.row).append_column("distance", pa.array(self.distance))


def _local_top_k(shared, k: int, pk: str, vec: str, payload: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        near = _Nearest(unit, k, pk)
        for batch in batches:
            if batch.num_rows:
                near.add(_matrix(batch.column(vec)), pa.Table.from_batches([batch.select(payload)]))
        if near.rows is not None:
            query, rows = near.best()
            ids = pa.array(query_ids, type=schema.field("query_id").type).take(pa.array(query))
            yield from rows.add_column(0, "query_id", ids).combine_chunks().cast(schema).to_batches(max_chunksize=OUT)

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, pk: str, vec: str = "embedding", payload: list[str] | None = None
) -> DataFrame:
    """The k nearest rows per query: (query_id, payload..., distance, rank).

    ``queries`` has (query_id, query_vec). Rows without a direction (zero or missing
    vectors) have no cosine and take no part. Ties go to the smaller key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    payload = [pk, *[c for c in (payload or []) if c != pk]]
    usable = vectors.where(F.exists(vec, lambda x: x != 0)).select(*payload, vec)
    query_type = queries.schema["query_id"].dataType
    out_schema = T.StructType(
        [T.StructField("query_id", query_type)]
        + [T.StructField(c, vectors.schema[c].dataType) for c in payload]
        + [T.StructField("distance", T.DoubleType())]
    )
    arrow_schema = to_arrow_schema(out_schema)

    queries = queries.select("query_id", "query_vec").where(F.exists("query_vec", lambda x: x != 0))
    n, dim = queries.agg(F.count("*"), F.max(F.size("query_vec"))).first()
    passes = n // max(1, min(QUERIES_PER_PASS, COMPONENTS // (dim or 1), KEPT // k)) + 1
    near = None
    for i in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id", "query_vec"), F.lit(passes)) == i)
        rows = part.collect()
        if rows:
            block = ([r["query_id"] for r in rows], np.asarray([r["query_vec"] for r in rows], dtype=np.float64))
            shared = vectors.sparkSession.sparkContext.broadcast(block)
            found = usable.mapInArrow(_local_top_k(shared, k, pk, vec, payload, arrow_schema), out_schema)
            near = found if near is None else near.unionAll(found)
    if near is None:
        near = vectors.sparkSession.createDataFrame([], out_schema)
    order = Window.partitionBy("query_id").orderBy("distance", pk)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
