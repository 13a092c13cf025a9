"""Whitening of embeddings: blockwise QR of the centred rows, a bidiagonal qd solver for its triangle, projection of every row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.qd import right_vectors
from dossier.llm.shared import over_batches, stored

#: Entries are taken in steps of 1 / SCALE and moved by OFFSET; farther than BOUND steps from zero they count as BOUND, so that sums stay exact.
SCALE, OFFSET, BOUND = 64, 1_000_000, 2**40
#: Directions returned. Those with a variance below FLAT of the largest one are rounding, not data, and are left out.
COMPONENTS, FLAT = 16, 1e-18
#: Triangles merged by one task; numbers of a block that is factorised at once.
FAN, BLOCK = 16, 1_000_000


def quantised(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dim`` entries, none null or not finite, and their entries as whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    flat = pc.cast(pc.list_flatten(column.take(pa.array(at))), pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    sound = np.isfinite(values).all(axis=1)
    steps = np.clip(np.floor(SCALE * values[sound]), -BOUND, BOUND)
    return at[sound], steps.astype(np.int64) + OFFSET


def _keys(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, x = quantised(batch.column(0), dim)
        data = np.ascontiguousarray(x.astype("<i8")).view(f"V{8 * dim}").ravel()
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in data], pa.binary())], ["x"])


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    rows = max(1, BLOCK // dim)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.column(0).slice(start, rows)
            yield np.frombuffer(b"".join(part.to_pylist()), dtype="<i8").reshape(len(part), dim)


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(dim, dtype=np.int64)
    for x in _matrices(batches, dim):
        n += len(x)
        total += x.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array(np.concatenate([[n], total]))], ["at", "value"])


def _triangles(batches: Iterator[pa.RecordBatch], dim: int, mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The triangle of a task's centred rows."""
    r = np.zeros((0, dim))
    for x in _matrices(batches, dim):
        r = np.linalg.qr(np.vstack([r, x - mean]), mode="r")
    if len(r):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["task", "r"])


def _merged(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """One triangle for each FAN triangles, from rows in the order of tasks."""
    group, r = None, np.zeros((0, dim))

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["task", "r"])

    for batch in batches:
        for task, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if group not in (None, task // FAN):
                yield row()
                r = np.zeros((0, dim))
            group = task // FAN
            r = np.linalg.qr(np.vstack([r, np.frombuffer(data).reshape(-1, dim)]), mode="r")
    if group is not None:
        yield row()


def _products(batches: Iterator[pa.RecordBatch], dim: int, mean: np.ndarray, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of products of whitened columns over a task's rows."""
    k = turn.shape[1]
    total = np.zeros((k, k))
    for x in _matrices(batches, dim):
        w = (x - mean) @ turn
        total += w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "value"])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2; None where it does not fit 64 bits."""
    rough = ((float(n) * x - sums) ** 2).sum(axis=1)
    if float(n) * (BOUND + OFFSET) < 2**62 and (rough < 2**62).all():
        d = n * x - sums
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return [d if d < 2**63 else None for d in exact]


def _projected(batches: Iterator[pa.RecordBatch], dim: int, n: int, sums: np.ndarray, turn: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    mean, k = sums / n, turn.shape[1]
    rows = max(1, BLOCK // (dim + COMPONENTS))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            at, x = quantised(part.column(1), dim)
            m = len(at)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(np.repeat(np.array(deviations(x, n, sums), dtype=object), k).tolist(), pa.int64()), pa.array(((x - mean) @ turn).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names)


def _gathered(df: DataFrame) -> np.ndarray:
    """Column ``value`` summed by ``at``: as many rows as the matrix has entries, whatever the table."""
    return np.array([r["value"] for r in df.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()])


def triangle(fit: DataFrame, dim: int, mean: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows: a triangle a task, then FAN triangles to one in rounds; at most FAN reach the driver."""
    parts = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(over_batches(fit, partial(_triangles, dim=dim, mean=mean), "task long, r binary"), "triangles")
    while found.count() > FAN:
        group = (F.col("task") / FAN).cast("long")
        found = stored(over_batches(found.repartition(parts, group).sortWithinPartitions("task"), partial(_merged, dim=dim), "task long, r binary"), "triangles")
    r = np.vstack([np.zeros((dim, dim)), *(np.frombuffer(row["r"]).reshape(-1, dim) for row in found.orderBy("task").collect())])
    return np.linalg.qr(r, mode="r")


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every sound row and component.

    Rows whose vector is null, empty, of another length than most (of equally many the longest), or holds null or non-finite entries are left out. Entries become whole
    numbers x; mean and covariance are those of the distinct x. Components are its unit eigenvectors by falling eigenvalue, the largest entry of each
    positive; ``whitened`` is a row's centred x on the component over the root of the eigenvalue. Directions without variance are no components, so a table of one
    distinct vector gives no rows, like an empty one. Repeated rows and ties give repeated answers, null keys stay, further columns play no part.
    ``deviation`` is null where it does not fit 64 bits.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"))
    usual = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    fit = stored(over_batches(vectors.select("embedding"), partial(_keys, dim=dim), "x binary").distinct(), "fit-vectors")
    n, *sums = (int(v) for v in _gathered(over_batches(fit, partial(_sums, dim=dim), "at long, value long")))
    if not n:
        return spark.createDataFrame([], schema)
    sums = np.array(sums)
    squares, directions = right_vectors(triangle(fit, dim, sums / n))
    kept = int((squares[:components] > FLAT * squares[0]).sum()) if squares[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], schema)
    directions = directions[:, :kept] * np.sign(directions[np.abs(directions[:, :kept]).argmax(axis=0), np.arange(kept)])
    turn = directions / np.sqrt(squares[:kept] / n)
    products = _gathered(over_batches(fit, partial(_products, dim=dim, mean=sums / n, turn=turn), "at long, value double"))
    error = float(np.abs(products.reshape(kept, kept) / n - np.eye(kept)).max())
    fn = partial(_projected, dim=dim, n=n, sums=sums, turn=turn, explained=squares[:kept] / squares.sum(), error=error)
    return over_batches(vectors, fn, schema)
