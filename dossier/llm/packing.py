"""Harmonic packing of token pieces into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import over_batches, slices, stored
from dossier.llm.vocabulary import encoder

#: Classes up to this many pieces a bin have a fixed count; all shorter pieces fill bins one after the other.
LAST_CLASS = 32
#: Classes whose even share leaves more of the capacity unused than this are not cut to.
WASTE = 8
#: Open pieces that one task puts together at the end; more of them take another round over several tasks. A task leaves fewer than
#: LAST_CLASS ** 2 / 2 + 1024 pieces open, so with this many a task every round makes them fewer.
LAST_ROUND = 50_000

PLACED = "sequence_id long, offset long"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def harmonic_sizes(capacity: int) -> list[int]:
    """Largest piece of every reciprocal class that is cut to, longest first: capacity // k for k pieces a bin."""
    return [capacity // k for k in range(1, LAST_CLASS + 1) if capacity // k > 0 and capacity % k <= min(WASTE, capacity // 64)]


def cut(n: int, sizes: list[int]) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: always the longest harmonic size that fits, then a tail below the shortest."""
    out = []
    for size in sizes:
        whole, n = divmod(n, size)
        out += [size] * whole
    return out + [n] * (n > 0)


def class_of(length: int, capacity: int) -> int:
    """k for lengths in (capacity / (k + 1), capacity / k], 0 for those beyond the last class."""
    k = capacity // length
    return k if k <= LAST_CLASS else 0


class Bins:
    """Open bins of one task, one a class; a bin of class k is closed by its k-th piece, that of short pieces when the next doesn't fit."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}
        self.used = 0

    def add(self, piece: tuple, length: int) -> Iterator[tuple]:
        """Takes a piece; yields (piece, sequence_id, offset) of every bin that this closes."""
        k = class_of(length, self.capacity)
        if k == 0:
            if self.used + length > self.capacity:
                yield from self._close(0)
                self.used = 0
            self.used += length
            self.open.setdefault(0, []).append((piece, length))
            return
        self.open.setdefault(k, []).append((piece, length))
        if len(self.open[k]) == k:
            yield from self._close(k)

    def _close(self, k: int) -> Iterator[tuple]:
        offset = 0
        for piece, length in self.open.pop(k):
            yield piece, self.next_id, offset
            offset += length
        self.next_id += 1

    def rest(self) -> Iterator[tuple]:
        """Pieces of bins that are still open."""
        for pieces in self.open.values():
            yield from pieces


def best_fit(pieces: list[tuple[tuple, int]], capacity: int, first_id: int) -> Iterator[tuple]:
    """Bounded rest of all classes: longest piece first, each into the fullest bin that it fits."""
    room: list[tuple[int, int]] = []
    at: dict[int, int] = {}
    for piece, length in sorted(pieces, key=lambda p: (-p[1], repr(p[0]))):
        i = bisect_left(room, (length, -1))
        left, bin_id = room.pop(i) if i < len(room) else (capacity, first_id + len(at))
        yield piece, bin_id, at.get(bin_id, 0)
        at[bin_id] = at.get(bin_id, 0) + length
        if left > length:
            insort(room, (left - length, bin_id))


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(key: pa.DataType) -> pa.Schema:
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.schema([("doc_id", key), *[(n, pa.int64()) for n in names]])


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, round_no: int) -> Iterator[pa.RecordBatch]:
    encode, sizes, schema = encoder(path).ids, harmonic_sizes(capacity), None
    bins = Bins(capacity, _first_id(round_no))
    for batch in slices(batches):
        schema = _schema(batch.schema.field(0).type)
        placed = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
            start = 0
            for length in cut(len(ids), sizes):
                piece = (doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()), len(ids))
                placed += [(*p, s, o) for p, s, o in bins.add(piece, length)]
                start += length
        yield _records(placed, schema)
    if schema is not None:
        yield _records([(*p, None, None) for p, _ in bins.rest()], schema)


def _repacked(batches: Iterator[pa.RecordBatch], capacity: int, round_no: int, last: bool) -> Iterator[pa.RecordBatch]:
    bins, kept, schema = Bins(capacity, _first_id(round_no)), [], None
    for batch in batches:
        schema = _schema(batch.schema.field(0).type)
        placed = []
        for piece in zip(*(c.to_pylist() for c in batch.columns[:5])):
            if last:
                kept.append((piece, piece[2]))
            else:
                placed += [(*p, s, o) for p, s, o in bins.add(piece, piece[2])]
        yield _records(placed, schema)
    if schema is not None:
        done = best_fit(kept, capacity, _first_id(round_no)) if last else ((p, None, None) for p, _ in bins.rest())
        yield _records([(*p, s, o) for p, s, o in done], schema)


def _first_id(round_no: int) -> int:
    """First sequence id of this task: rounds and partitions have ranges of their own, the same when a task runs again."""
    return round_no << 58 | TaskContext.get().partitionId() << 34


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``. It is cut greedily into harmonic sizes ``capacity // k``, so that k pieces fill a bin of class k
    but for a few tokens; the tail goes to the class of its length. Every task fills the bins of each class by count alone, without looking
    at other tasks. What is left open in a task (fewer than k pieces a class, however long its input) is packed in further rounds over ever fewer
    tasks; the last, of a bounded number of pieces, packs all classes together by best fit.

    A null text is empty: one piece of one token. Repeated rows are packed once each. A null key stays. No rows give no pieces. Other
    columns play no part. Each round is stored before it is read twice, so a lost executor can't make two answers of one round.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECES}, {PLACED}"
    work = partial(_tokenized, path=tokenizer, end_id=end_id, capacity=capacity, round_no=0)
    done = stored(over_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), work, schema), "packed")
    result, round_no = done.where("sequence_id IS NOT NULL"), 1
    rest = done.where("sequence_id IS NULL")
    while (left := rest.count()) > 0:
        last = left <= LAST_ROUND
        parts = 1 if last else left // LAST_ROUND + 1
        spread = rest.coalesce(1) if last else rest.repartition(parts, "doc_id", "start")
        done = stored(over_batches(spread, partial(_repacked, capacity=capacity, round_no=round_no, last=last), schema), "packed")
        result = result.union(done.where("sequence_id IS NOT NULL"))
        rest, round_no = done.where("sequence_id IS NULL"), round_no + 1
        if last:
            break
    return result
