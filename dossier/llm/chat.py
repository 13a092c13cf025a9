"""Chat formatting: conversations as one text with marked turns, assembled column by column in a byte buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import over_batches

#: A turn is OPEN role MIDDLE text CLOSE; ESCAPE stands in front of every byte of the texts and roles that the marks begin with.
OPEN, MIDDLE, CLOSE, ESCAPE = b"### ", b":\n", b"\n</turn>\n", b"\\"
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[list(b"\\#<:")] = True
TRAINED_ROLE = "assistant"
FRAGMENT = "conv_id {key}, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
#: Bytes of text that are assembled at once, unless one turn is longer.
FRAGMENT_BYTES = 8_000_000


def escaped(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings with ESCAPE set in front of marked bytes, and where each string begins (and the last ends)."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    marked = _ESCAPED[data]
    before = np.concatenate([[0], np.cumsum(marked)])
    at = np.arange(len(data)) + before[1:]
    out = np.full(len(data) + int(before[-1]), ESCAPE[0], dtype=np.uint8)
    out[at] = data
    starts = offsets - offsets[0]
    return out, starts + before[starts]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns: bytes, start of every turn (and the end), and start and end of every text.

    Lengths of the five segments of a turn give cumulative offsets; each kind of segment is then copied for all turns at once, to places that are its
    own running index plus the shift of its turn.
    """
    role_bytes, role_at = escaped(roles)
    text_bytes, text_at = escaped(texts)
    n = len(role_at) - 1
    lengths = np.empty((n, 5), dtype=np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(MIDDLE), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, dtype=np.uint8)
    for column, mark in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[starts[:, column, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for column, data, at in ((1, role_bytes, role_at), (3, text_bytes, text_at)):
        out[np.arange(len(data)) + np.repeat(starts[:, column] - at[:-1], lengths[:, column])] = data
    return out, np.append(starts[:, 0], len(out)), starts[:, 3], ends[:, 3]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to fragments: turns of one conversation that stand together, up to FRAGMENT_BYTES or the end of a batch."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        offsets = np.frombuffer(batch.column(3).cast(pa.large_binary()).buffers()[1], np.int64)[: batch.num_rows + 1]
        cuts = np.flatnonzero(np.diff(offsets[:-1] // FRAGMENT_BYTES)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []
        for low, high in zip(bounds, bounds[1:]):
            yield _fragments(batch.slice(low, high - low), number + low)
        number += batch.num_rows


def _fragments(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    key, roles, texts = batch.column(0), batch.column(2), batch.column(3)
    keys = key.to_pylist()
    first = np.array([i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]])
    data, starts, low, high = assemble(roles, texts)
    # offsets in code points: bytes that do not continue a character
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    bounds = np.append(first, batch.num_rows)
    offsets = starts[bounds].astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    trained = np.flatnonzero([r == TRAINED_ROLE for r in roles.to_pylist()])
    origin = points[offsets[np.searchsorted(bounds, trained, side="right") - 1]]
    spans = pa.StructArray.from_arrays([pa.array(points[low[trained]] - origin), pa.array(points[high[trained]] - origin)], ["start", "end"])
    losses = pa.ListArray.from_arrays(pa.array(np.searchsorted(trained, bounds).astype(np.int32)), spans)
    columns = [key.take(pa.array(first)), pa.array(number + first), pa.array(np.diff(bounds)), strings.cast(pa.string()), losses]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n_turns", "formatted", "loss"])


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss``: each conversation as fragments to be joined in order of ``part``.

    A turn is ``### role:`` and a line feed, the text, a line feed and ``</turn>`` and a line feed. A backslash stands in front of every backslash, ``#``, ``<`` and ``:`` of
    roles and texts, so no text can open or close a turn, and taking the backslashes off gives it back. ``loss`` has the spans of
    assistant texts in the fragment, in code points. Most conversations are one fragment. Turns are dealt out by ranges of (conversation, turn), so a very
    long conversation is spread over tasks; ``part`` is the number of the fragment's first turn among all ordered turns of its task, after the task's own number.

    Turns are ordered by turn (null first); ties by role, then text. Null roles and texts are empty. Rows with a null conversation are one conversation.
    Repeated rows are turns each. No rows give none; other columns play no part.
    """
    rows = turns.select(F.col(key).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = turns.schema[key].dataType.simpleString()
    return over_batches(dealt, _formatted, FRAGMENT.format(key=kind))


_TURN = re.compile(r"### ([^\\#<:]*(?:\\.[^\\#<:]*)*):\n([^\\#<]*(?:\\.[^\\#<]*)*)\n</turn>\n", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def plain(value: str) -> str:
    """A role or text without its escapes."""
    return _UNESCAPE.sub(r"\1", value) if "\\" in value else value


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn of a formatted text; anything else than whole turns is an error."""
    out, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        out.append((plain(turn[1]), plain(turn[2])))
        at = turn.end()
    return out


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, key) -> None:
        self.key, self.turns, self.loss = key, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in loss:
            text = plain(formatted[span["start"]:span["end"]])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams fragments in order and keeps the digests of one conversation."""
    names, types = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None
    current: _Digest | None = None
    for batch in batches:
        types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done = []
        for key, formatted, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss"))):
            if current is None or current.key != key:
                done += [current.row()] if current else []
                current = _Digest(key)
            current.add(formatted, loss)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(current.row(), types)], names)


def digests(fragments: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from formatted texts and loss spans."""
    kind = fragments.schema["conv_id"].dataType.simpleString()
    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = fragments.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part")
    return over_batches(ordered, _read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
