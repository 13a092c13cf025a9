"""Verbatim benchmark passages in documents, found by suffix arrays of the documents' words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.shared import alnum_words, fresh_name, over_batches, slices

WINDOW = 10
#: Words of benchmark text that are broadcast at a time; a larger benchmark takes more blocks, each in a pass of its own.
BLOCK_WORDS = 2_000_000
#: Words of a shard: documents whose suffixes are sorted together.
SHARD_WORDS = 400_000

RESULT = "n_words long, n_hit long, n_items long, items array<string>, longest long, longest_item string, longest_at long, hits array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


_MIX = np.random.default_rng(7).integers(0, 2**63, 3, dtype=np.uint64) | np.uint64(1)


class _Hashed:
    """Sums of hashed words times powers of a number, from which the hash of any stretch follows. Zeros match nothing on another ``side``."""

    def __init__(self, words: np.ndarray, side: int) -> None:
        values = words.astype(np.uint64)
        values = np.where(values > 0, values, np.uint64(1 << 62 | side)) * _MIX[0]
        values = (values ^ values >> np.uint64(29)) * _MIX[1]
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), _MIX[2])]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((values ^ values >> np.uint64(32)) * self.powers[:-1], dtype=np.uint64)])


def _equal(a: _Hashed, b: _Hashed, at: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    powers = a.powers if len(a.powers) > len(b.powers) else b.powers
    return (a.sums[at + length] - a.sums[at]) * powers[other] == (b.sums[other + length] - b.sums[other]) * powers[at]


class Suffixes:
    """Test suffixes of a benchmark block, ready to be looked up: word numbers, windows and the item of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]]) -> None:
        self.items = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        numbers, owner, left = [], [], []
        for i, (_, words) in enumerate(items):
            numbers += [self.number.setdefault(w, len(self.number) + 1) for w in words] + [0]
            owner += [i] * (len(words) + 1)
            left += [*range(len(words), -1, -1)]
        self.words = np.array(numbers, dtype=np.int64)
        self.owner, left = np.array(owner, dtype=np.int64), np.array(left, dtype=np.int64)
        first = np.concatenate([[0], np.flatnonzero(left == 0)[:-1] + 1]) if len(left) else np.array([], np.int64)
        size = left[first] if len(left) else left
        # a suffix is a window where ten words are left, and at the start of a shorter item
        whole = size[self.owner] if len(left) else left
        self.need = np.where(left >= WINDOW, WINDOW, np.where((left == whole) & (left > 0), left, 0))
        self.at = np.flatnonzero(left > 0)
        self.left = left
        self.bits = max(1, int(len(self.number) + 1).bit_length())
        self.pairs = np.unique(self._pairs(self.words)) if len(self.words) else np.array([], np.int64)
        self.lone = bool((self.need == 1).any())
        self._sort_windows()

    def _sort_windows(self) -> None:
        """Distinct windows, each looked up once: one of their suffixes, all of them by the word in front, and their items."""
        asked = np.flatnonzero(self.need > 0)
        table = np.column_stack([self.need[asked], self.keys(self.words, asked)]) if len(asked) else np.zeros((0, 2), np.int64)
        _, first, kind = np.unique(table, axis=0, return_index=True, return_inverse=True)
        kind = kind.ravel()
        self.window, self.window_need = asked[first], self.need[asked[first]]
        self.wide = len(self.number) + 1
        front = np.where(asked > 0, self.words[asked - 1], 0) if len(asked) else asked
        order = np.argsort(kind * self.wide + front, kind="stable")
        self.suffixes, self.fronts = asked[order], (kind * self.wide + front)[order]
        self.window_items = np.unique(np.column_stack([kind, self.owner[asked]]), axis=0) if len(asked) else np.zeros((0, 2), np.int64)
        self.hashed = _Hashed(self.words, 1)

    def _pairs(self, numbers: np.ndarray) -> np.ndarray:
        """Number of each word with the next one; 0 where either is missing."""
        after = np.append(numbers[1:], 0)
        return np.where((numbers > 0) & (after > 0), numbers << self.bits | after, 0)

    def keys(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The WINDOW words at each place as a few sortable numbers, the first words in the highest bits; beyond a 0 come zeros."""
        per = 62 // self.bits
        padded = np.concatenate([numbers, np.zeros(WINDOW, np.int64)])
        columns, alive = [], np.ones(len(at), dtype=bool)
        for first in range(0, WINDOW, per):
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(first, first + per):
                word = padded[at + k] if k < WINDOW else np.zeros(len(at), np.int64)
                alive = alive & (word > 0)
                key = key << self.bits | np.where(alive, word, 0)
            columns.append(key)
        return np.stack(columns, axis=1)

    def top(self, need: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The largest key that begins with the first ``need`` words of each key."""
        per, out = 62 // self.bits, keys.copy()
        for column in range(keys.shape[1]):
            free = np.clip((column + 1) * per - need, 0, per) * self.bits
            out[:, column] |= (np.int64(1) << free) - 1
        return out


def _order(keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys.T[::-1])


def _search(sorted_keys: np.ndarray, asked: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every asked key in the sorted ones: how many are smaller (or, with ``after``, not larger)."""
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(sorted_keys), np.int64)
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high) // 2, 0)
        seen = sorted_keys[middle]
        less, equal = np.zeros(len(asked), bool), np.ones(len(asked), bool)
        for c in range(asked.shape[1]):
            less |= equal & (seen[:, c] < asked[:, c])
            equal &= seen[:, c] == asked[:, c]
        right = open_ & (less | equal if after else less)
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


class Shard:
    """Suffix array over the words of some documents.

    It holds the suffixes that begin with two words of some test suffix (with one, if an item is a single word): no other can match. They are
    ordered by as many words as a window has.
    """

    def __init__(self, tests: Suffixes, docs: list[list[bytes]]) -> None:
        number = tests.number.get
        numbers, bounds = [], [0]
        for words in docs:
            numbers += [number(w, 0) for w in words]
            numbers.append(0)
            bounds.append(len(numbers))
        self.tests, self.bounds = tests, np.array(bounds, dtype=np.int64)
        self.numbers = np.array(numbers, dtype=np.int64)
        if tests.lone:
            at = np.flatnonzero(self.numbers > 0)
        else:
            pairs = tests._pairs(self.numbers)
            at = np.flatnonzero(pairs)
            at = at[np.isin(pairs[at], tests.pairs)]
        keys = tests.keys(self.numbers, at)
        order = _order(keys)
        self.at, self.sorted = at[order], keys[order]

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """``(place, window)`` of every occurrence of every distinct window."""
        tests = self.tests
        if not len(tests.window) or not len(self.at):
            return (np.array([], np.int64),) * 2
        keys = tests.keys(tests.words, tests.window)
        tops = tests.top(tests.window_need, keys)
        low, high = _search(self.sorted, keys, after=False), _search(self.sorted, tops, after=True)
        count = high - low
        each = np.repeat(np.arange(len(keys)), count)
        place = self.at[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
        return place, each

    def longest(self, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place, test suffix, length)`` of the matches that no word in front makes longer; the longest match of a text is one of them."""
        tests = self.tests
        front = np.where(place > 0, self.numbers[place - 1], 0)
        base = window * tests.wide
        start, end = np.searchsorted(tests.fronts, base), np.searchsorted(tests.fronts, base + tests.wide)
        cut = np.where(front > 0, np.searchsorted(tests.fronts, base + front), end)
        again = np.where(front > 0, np.searchsorted(tests.fronts, base + front, side="right"), end)
        low, count = np.concatenate([start, again]), np.concatenate([cut - start, end - again])
        each = np.repeat(np.arange(len(low)), count)
        test = tests.suffixes[low[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
        place, need = np.tile(place, 2)[each], np.tile(tests.window_need[window], 2)[each]
        return place, test, self.extended(place, test, need)

    def extended(self, place: np.ndarray, test: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How far each match goes on beyond its window: a binary search over hashes of stretches."""
        own, other = _Hashed(self.numbers, 2), self.tests.hashed
        low, high = length.copy(), np.minimum(len(self.numbers) - place, len(self.tests.words) - test)
        while len(going := np.flatnonzero(low < high)):
            middle = (low[going] + high[going] + 1) // 2
            # most matches end at once, so the first steps are short
            middle = np.minimum(middle, np.maximum(low[going] + 1, 2 * low[going] - length[going]))
            same = _equal(own, other, place[going], test[going], middle)
            low[going] = np.where(same, middle, low[going])
            high[going] = np.where(same, high[going], middle - 1)
        return low


def _spans(places: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Places covered, as few spans; ``places`` ascend."""
    out: list[dict] = []
    for start, end in zip(places.tolist(), ends.tolist()):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _of_shard(tests: Suffixes, docs: list[list[bytes]]) -> list[tuple]:
    shard = Shard(tests, docs)
    place, window = shard.matches()
    rows: list[tuple] = [(len(words), 0, 0, [], 0, None, None, []) for words in docs]
    if not len(place):
        return rows
    order = np.argsort(place, kind="stable")
    place, window = place[order], window[order]
    need = tests.window_need[window]
    start_of, test_of, length = shard.longest(place, window)
    owner = np.searchsorted(shard.bounds, start_of, side="right") - 1
    # of each text the longest match, then the earliest, then the smallest item (items are numbered in their order)
    best = np.lexsort((tests.owner[test_of], start_of, -length, owner))
    best = best[np.searchsorted(owner[best], np.arange(len(docs)))[np.unique(owner)]]
    top = {int(owner[i]): i for i in best}
    doc = np.searchsorted(shard.bounds, place, side="right") - 1
    for start, end in zip(*_runs(doc)):
        d = int(doc[start])
        at = place[start:end] - shard.bounds[d]
        hits = _spans(at, at + need[start:end])
        kinds = np.unique(window[start:end])
        low, high = np.searchsorted(tests.window_items[:, 0], kinds), np.searchsorted(tests.window_items[:, 0], kinds, side="right")
        items = sorted({tests.items[i] for a, b in zip(low.tolist(), high.tolist()) for i in tests.window_items[a:b, 1].tolist()})
        i = top[d]
        rows[d] = (len(docs[d]), sum(h["end"] - h["start"] for h in hits), len(items), items, int(length[i]), tests.items[tests.owner[test_of[i]]], int(start_of[i] - shard.bounds[d]), hits)
    return rows


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(values)) + 1
    return np.concatenate([[0], edges]), np.concatenate([edges, [len(values)]])


_FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()),
           ("longest_item", pa.string()), ("longest_at", pa.int64()), ("hits", _SPANS)]
_NAMES = [name for name, _ in _FIELDS]


def _merged(a: tuple, b: tuple) -> tuple:
    """Answers of two benchmark blocks on the same text."""
    x, y = dict(zip(_NAMES, a)), dict(zip(_NAMES, b))
    hits = sorted((h["start"], h["end"]) for h in x["hits"] + y["hits"])
    spans = _spans(np.array([h[0] for h in hits], np.int64), np.array([h[1] for h in hits], np.int64))
    items = sorted({*x["items"], *y["items"]})
    best = min(x, y, key=lambda z: (-z["longest"], z["longest_at"] or 0, z["longest_item"] or ""))
    return x["n_words"], sum(h["end"] - h["start"] for h in spans), len(items), items, best["longest"], best["longest_item"], best["longest_at"], spans


def _searched(batches: Iterator[pa.RecordBatch], block, text: int, earlier: int | None, into: str) -> Iterator[pa.RecordBatch]:
    tests: Suffixes = block.value
    for batch in slices(batches):
        rows, held, size = [], [], 0
        for value in batch.column(text).to_pylist():
            held.append(alnum_words(value))
            size += len(held[-1])
            if size > SHARD_WORDS:
                rows += _of_shard(tests, held)
                held, size = [], 0
        rows += _of_shard(tests, held)
        columns, names = batch.columns, batch.schema.names
        if earlier is not None:
            rows = [_merged(tuple(old.values()), new) for old, new in zip(batch.column(earlier).to_pylist(), rows)]
            columns, names = columns[:-1], names[:-1]
        result = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], _NAMES)
        yield pa.RecordBatch.from_arrays([*columns, result], [*names, into])


def _words_of(text: str) -> Column:
    return F.size(F.split(F.col(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def _blocks(benchmark: DataFrame, item: str, text: str) -> list:
    """Broadcast blocks of the benchmark, none over about BLOCK_WORDS words unless a single item is."""
    asked = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = asked.agg(F.sum(_words_of("text"))).first()[0] or 0
    n = int(total // BLOCK_WORDS) + 1
    context = benchmark.sparkSession.sparkContext
    out = []
    for i in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        items = sorted((r["item"] if r["item"] is not None else "", alnum_words(r["text"])) for r in part.collect())
        out.append(context.broadcast(Suffixes([(name, words) for name, words in items if words])))
    return out


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "found") -> DataFrame:
    """All rows and columns of ``docs`` and a struct column ``into``, a name that ``docs`` must not have.

    The struct has n_words, n_hit (words inside an occurrence of a window of ten item words; an item of fewer words is one window), n_items and
    items (ids as sorted strings), the longest verbatim match (longest, longest_item, longest_at: the earliest, then the smallest item) and the hit
    spans as word positions. Every task sorts the suffixes of its documents a shard at a time and looks every test suffix up by binary search, so
    nothing is shuffled. The benchmark goes out in blocks of a bounded number of words; each block is a pass whose answers are put together row by row.

    Null or wordless texts have no words and no hits. Items without words match nothing; a null item id counts as an empty one; items that share an
    id are one item. An empty benchmark finds nothing. Repeated rows give repeated rows.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType.fromDDL(RESULT))])
    rows, at = docs, docs.columns.index(text)
    for i, block in enumerate(_blocks(benchmark, item, item_text)):
        rows = over_batches(rows, partial(_searched, block=block, text=at, earlier=len(docs.columns) if i else None, into=into), schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the longest match of every row."""
    found = search(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), benchmark)
    return found.select("doc_id", "found.n_words", "found.n_hit", "found.n_items", F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
                        (F.col("found.n_hit") > 0).alias("contaminated"), "found.longest", "found.longest_item", "found.longest_at")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` without a hit, with all their columns."""
    into = fresh_name(docs, "found")
    return search(docs, benchmark, text, into=into).where(F.col(into)["n_hit"] == 0).drop(into)
