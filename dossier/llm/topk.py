"""Exact top-k by integer inner product: term-at-a-time accumulation over blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.shared import over_batches

#: Queries of one broadcast; more of them take more passes.
QUERY_BLOCK = 16_384
#: Score cells that a task holds at a time.
SCORES = 4_000_000
#: Candidates whose postings are made at a time.
CANDIDATES = 8_192
#: Terms found in more than this share of the candidates are accumulated together as dense rows.
DENSE = 0.25
#: Whole numbers that doubles add up exactly.
EXACT = 2.0 ** 53


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component x as double; null for vectors that are null or hold null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.astype(np.float64).reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


class Postings:
    """Candidates of a block by term: places with a weight other than zero, and the weights."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.n, self.width = vectors.shape
        filled = (vectors != 0).sum(axis=0)
        self.dense = np.flatnonzero(filled > DENSE * self.n)
        self.rows = np.ascontiguousarray(vectors[:, self.dense].T)
        self.lists = {int(t): (at := np.flatnonzero(vectors[:, t]), vectors[at, t]) for t in np.flatnonzero((filled > 0) & (filled <= DENSE * self.n))}
        self.largest = float(np.abs(vectors).max(initial=0.0))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Dense score arrays of some queries, every term of which adds its weighted postings to all scores it touches."""
        out = weights[:, self.dense] @ self.rows
        for term, (at, values) in self.lists.items():
            asking = np.flatnonzero(weights[:, term])
            if len(asking):
                out[np.ix_(asking, at)] += np.multiply.outer(weights[asking, term], values)
        return out


def _whole_scores(weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Scores beyond the exact range of doubles, by whole numbers of any size, held to the range of a long."""
    rows = [[int(x) for x in row] for row in vectors]
    asked = [[int(x) for x in row] for row in weights]
    return np.array([[max(1 - 2**63, min(2**63 - 1, sum(map(int.__mul__, q, v)))) for v in rows] for q in asked], dtype=np.int64).reshape(len(asked), len(rows))


NONE = np.iinfo(np.int64).min


def _first_k(row: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of flat candidates (query row, score, id) the first k of every row, by falling score and rising id."""
    order = np.lexsort((vec_id, ~score, row))
    row, score, vec_id = row[order], score[order], vec_id[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], vec_id[keep]


def _reaching(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells that can be among the k best of their row: all from the k-th score on, found by partition."""
    if scores.shape[1] > k:
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        return np.nonzero((scores >= bound[:, None]) & (scores != NONE))
    return np.nonzero(scores != NONE)


def _ranked(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of this task for every query of the block."""
    number, ids, weights = block.value
    largest = float(np.abs(weights).max(initial=0.0))
    best = (np.array([], np.int64),) * 3
    for batch in batches:
        for start in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(start, CANDIDATES)
            vec_id, vectors = part.column(0).to_numpy(), _matrix(part.column(1))
            width = min(vectors.shape[1], weights.shape[1])
            vectors, asked = vectors[:, :width], weights[:, :width]
            postings = Postings(vectors)
            exact = largest * postings.largest * max(width, 1) < EXACT
            found = [best]
            for low in range(0, len(ids), step := max(1, SCORES // len(vec_id))):
                some = asked[low:low + step]
                scores = postings.scores(some).astype(np.int64) if exact else _whole_scores(some, vectors)
                scores[ids[low:low + step, None] == vec_id[None, :]] = NONE
                row, at = _reaching(scores, k)
                found.append((row + low, scores[row, at], vec_id[at]))
            best = _first_k(*map(np.concatenate, zip(*found)), k)
    row, score, vec_id = best
    yield pa.RecordBatch.from_arrays([pa.array(number[row]), pa.array(ids[row]), pa.array(vec_id), pa.array(score)], ["query", "query_id", "vec_id", "score"])


def _query_blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number, id and weights of the queries, one bounded block at a time on the driver."""
    n = asked.count() // QUERY_BLOCK + 1
    first = 0
    for i in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i)
        table = part.toArrow().combine_chunks()
        if table.num_rows:
            weights = _matrix(table.column("weights").combine_chunks())
            yield np.arange(first, first + table.num_rows), table.column("vec_id").to_numpy(), weights
            first += table.num_rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` the k rows of ``vectors`` with the highest scores, ties to the smaller id.

    The score is the inner product of the vectors with floor(scale * x) for each component x, as whole numbers. Every query meets every row: a block of
    candidates becomes postings by component, and each component of a query adds its weight times the postings to a dense array of scores.
    Components that most candidates have are added up for all queries together. A task keeps the k best by partition and sends them on, so the
    shuffle carries k rows a query and task. Queries go out in blocks of bounded size, each a pass over the candidates.

    Rows with the query's id are its own and no candidates. Vectors that are null or hold null or non-finite components take no part, as do
    rows without an id; an empty vector scores 0. Vectors of different lengths are compared over the shorter. Repeated candidates count each,
    and repeated queries are answered each. Scores beyond a long are held to its range. Fewer candidates than k give all; empty tables none.
    """

    def sound(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("weights")).where("vec_id IS NOT NULL AND weights IS NOT NULL")

    candidates, context = sound(vectors), vectors.sparkSession.sparkContext
    answers = None
    for block in _query_blocks(sound(queries)):
        part = over_batches(candidates, partial(_ranked, block=context.broadcast(block), k=k), "query long, query_id long, vec_id long, score long")
        answers = part if answers is None else answers.union(part)
    if answers is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
