"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import over_batches, slices, stored

#: Labelled texts that the model learns from, at most (chosen by hash); marks of its lexicon, at most.
LABELLED, LEXICON = 20_000, 2_000
#: Of the labelled texts this share draws the lexicon, this one grows the trees, and the rest calibrates.
DRAWS, GROWS = 0.5, 0.35
#: A mark stands in the lexicon if so many toxic texts, and this share of them, have it, and its log odds are so many deviations from zero.
LEAST_TEXTS, LEAST_SHARE, LEAST_Z = 3, 0.01, 3.3
#: Lengths of the openings of words that are marks like whole words are.
OPENINGS = (4, 5, 6)
#: Words between a lexicon word and a second person that still count as near.
NEAR = 5
#: Trees: their number, depth, step, bins of a feature, least weight of a leaf, and ridge.
TREES, DEPTH, STEP, BINS, LEAF, RIDGE = 80, 3, 0.15, 32, 3.0, 1.0

# Second persons of the four languages of the corpus.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen deinem deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Signs that stand for letters in obfuscated words.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})

FEATURES = (
    "lexicon_sum", "lexicon_max", "lexicon_density", "lexicon_root", "lexicon_words", "near_second", "second_density", "capital_words", "capitals",
    "exclamations", "questions", "punctuation", "runs", "obfuscated", "obfuscated_density", "signs_inside", "length",
)

_EDGES = re.compile(r"^\W+|\W+$")
_INSIDE = re.compile(r"[^\W\d_][\d@$!|*]+[^\W\d_]|(?<!\w)[^\W\d_](?:[.\-_ ][^\W\d_]){3,}(?!\w)")
_RUNS = re.compile(r"(\w)\1{3,}|[!?]{2,}")


def marks(word: str) -> list[str]:
    """What a word brings to the lexicon: itself, and its openings where it is longer."""
    return [word, *(f"{word[:n]}*" for n in OPENINGS if len(word) > n)]


def bare(token: str) -> str:
    return token if token.isalnum() else _EDGES.sub("", token)


def distinct_marks(text: str | None) -> set[str]:
    kinds = {bare(t) for t in (text or "").lower().split()} - {""}
    return {m for word in kinds for m in marks(word)}


class Describer:
    """FEATURES of texts under a lexicon; what a token weighs is worked out once."""

    KNOWN = 200_000

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.known: dict[str, tuple[str, float, bool, bool]] = {}

    def _heaviest(self, word: str) -> tuple[str, float]:
        """The mark of a word that weighs most, and its weight."""
        found = [(self.lexicon[m], m) for m in marks(word) if m in self.lexicon]
        weight, mark = max(found, default=(0.0, ""))
        return mark, weight

    def _token(self, token: str) -> tuple[str, float, bool, bool]:
        """Mark, weight, whether the token addresses somebody, and whether only its plain spelling is known."""
        seen = self.known.get(token)
        if seen is None:
            word = bare(token)
            mark, weight = self._heaviest(word)
            hidden = False
            if not weight and not word.isalpha() and (plain := token.translate(SIGNS)) != token:
                mark, weight = self._heaviest(bare(plain))
                hidden = weight > 0
            seen = (mark, weight, word in SECOND, hidden)
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            self.known[token] = seen
        return seen

    def features(self, text: str | None) -> list[float]:
        """A null or blank text has zeros."""
        raw = text.split() if text else []
        if not raw:
            return [0.0] * len(FEATURES)
        n, size = len(raw), len(text)
        told = list(map(self._token, text.lower().split()))
        hits = [i for i, t in enumerate(told) if t[1]]
        addressed = [i for i, t in enumerate(told) if t[2]]
        weights = {told[i][0]: told[i][1] for i in hits}
        total = sum(weights.values())
        near = 0
        if hits and addressed:
            places = np.array(addressed)
            at = np.searchsorted(places, hits)
            after = np.abs(places[np.minimum(at, len(places) - 1)] - hits)
            before = np.abs(places[np.maximum(at - 1, 0)] - hits)
            near = int((np.minimum(after, before) <= NEAR).sum())
        hidden = sum(told[i][3] for i in hits)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts = np.bincount(data, minlength=256)
        marks_ = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
        inside = len(_INSIDE.findall(text))
        return [
            min(total, 30.0), max(weights.values(), default=0.0), total / n, total / n ** 0.5, float(np.log1p(len(hits))), float(near), len(addressed) / n,
            sum(len(w) > 2 and w.isupper() for w in raw) / n, counts[65:91].sum() / size, counts[33] / n, counts[63] / n, marks_ / size,
            len(_RUNS.findall(text)) / n, float(hidden), hidden / n, inside / n, float(np.log1p(n)),
        ]


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees as flat arrays, one row a tree: nodes in level order, leaves behind them."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        """Newton steps of the logistic loss; splits between quantiles of a feature, found from histograms of gradients."""
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        rate = (y.sum() + 0.5) / (len(y) + 1)
        start = float(np.log(rate / (1 - rate)))
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        binned = np.column_stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)]) if len(x) else np.zeros(x.shape, int)
        score = np.full(len(y), start)
        feature, cut, leaf = (np.zeros((TREES, size), dtype=kind) for size, kind in ((inner, np.int64), (inner, float), (leaves, float)))
        for tree in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(DEPTH):
                width, first = 2**level, 2**level - 1
                best = np.zeros(width)
                chosen, bound = np.zeros(width, dtype=np.int64), np.full(width, BINS)
                for f, edges in enumerate(cuts):
                    place = node * (BINS + 1) + binned[:, f]
                    g, h = (np.bincount(place, w, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for w in (gradient, weight))
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + RIDGE) + (g_all - g)**2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                    gain = np.where((h >= LEAF / 4) & (h_all - h >= LEAF / 4), gain, 0.0)[:, :len(edges)]
                    if not gain.size:
                        continue
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(width), top] > best + 1e-9
                    best = np.where(better, gain[np.arange(width), top], best)
                    chosen, bound = np.where(better, f, chosen), np.where(better, top, bound)
                feature[tree, first:first + width] = chosen
                cut[tree, first:first + width] = [cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(chosen, bound)]
                node = 2 * node + (binned[np.arange(len(y)), chosen[node]] > bound[node])
            g, h = (np.bincount(node, w, minlength=leaves) for w in (gradient, weight))
            leaf[tree] = -STEP * g / (h + RIDGE)
            score = score + leaf[tree][node]
        return cls(start, feature, cut, leaf)

    def logit(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            score += leaf[node]
        return score


@dataclass(frozen=True)
class Isotonic:
    """A rising step function with its corners cut: linear between the middles of its steps."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, score: np.ndarray, y: np.ndarray) -> Isotonic:
        """Pools adjacent violators; a pool's rate is drawn half a case towards both labels, so none is certain."""
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # cases, toxic ones, sum of scores
        for s, label in zip(score[order].tolist(), y[order].tolist()):
            pools.append([1.0, label, s])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        n, toxic, total = (np.array(c) for c in zip(*pools)) if pools else (np.zeros(0),) * 3
        return cls(total / np.maximum(n, 1), np.maximum.accumulate((toxic + 0.5) / (n + 1))) if pools else cls(np.array([0.0]), np.array([0.5]))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    calibration: Isotonic | None

    def score(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1. A hundredth of it is the uncalibrated score, so that texts of one step keep their order."""
        if self.trees is None or self.calibration is None:
            return np.zeros(len(features))
        logit = self.trees.logit(features)
        return 0.99 * self.calibration(logit) + 0.01 / (1 + np.exp(-np.clip(logit, -30, 30)))


def remainder(key: str) -> Column:
    """CRC-32 of the key as text modulo 5; rows where it is 0 are held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        found = [distinct_marks(t) for t in batch.column(0).to_pylist()]
        labels = np.repeat(batch.column(1).to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array([m for f in found for m in f], pa.string()), pa.array(labels)], ["mark", "toxic"])


def lexicon(texts: DataFrame, limit: int = LEXICON) -> dict[str, float]:
    """Marks of toxic texts (columns ``text`` and ``toxic``, 0 or 1) and the lower bound of their log odds, the heaviest ``limit`` of them."""
    totals = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    toxic = float(totals["toxic"] or 0)
    clean = float(totals["n"]) - toxic
    counted = over_batches(texts.select("text", "toxic"), _marked, "mark string, toxic long").groupBy("mark").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (toxic + 1)) - F.log(b / (clean + 1))
    deviation = F.sqrt(1 / a + 1 / b)
    sound = (F.col("a") >= LEAST_TEXTS) & (F.col("a") >= LEAST_SHARE * toxic) & (odds / deviation >= LEAST_Z) & (odds - 2 * deviation > 0.5)
    kept = counted.where(sound).select("mark", (odds - 2 * deviation).alias("weight")).orderBy(F.desc("weight"), "mark").limit(limit)
    return {r["mark"]: float(r["weight"]) for r in kept.collect()}


def _described(batches: Iterator[pa.RecordBatch], words: dict[str, float]) -> Iterator[pa.RecordBatch]:
    describer = Describer(words)
    for batch in slices(batches):
        features = [describer.features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.float64())), *batch.columns[1:]], ["features", "toxic", "place"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", labelled: int = LABELLED) -> Model:
    """The model of at most ``labelled`` labelled texts of rows that are not held out.

    Each distinct text counts once, as toxic if any of its labels says so. Null keys, null labels and null texts teach nothing. The lexicon, the trees and
    the calibration come from three parts of the texts, so what one learns is honest for the next.
    """
    taught = remainder("_key") != 0
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max((F.col("toxic") > 0).cast("long")).alias("_toxic")).where(taught)
    share = labelled / max(known.count(), 1)
    if share < 1:
        # the same share of the range of a 64-bit hash
        known = known.where(F.xxhash64("_key") < int((2 * share - 1) * 2**63))
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where("text IS NOT NULL")
    texts = narrow.join(F.broadcast(known), "_key").groupBy("text").agg(F.max("_toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(10_000)) / 10_000
    texts = stored(texts.withColumn("place", place), "toxicity-texts")
    words = lexicon(texts.where(F.col("place") < DRAWS))
    rest = over_batches(texts.where(F.col("place") >= DRAWS), partial(_described, words=words), "features array<double>, toxic long, place double")
    rows = sorted((r["place"], list(r["features"]), r["toxic"]) for r in rest.collect())
    if not rows:
        return Model(words, None, None)
    place, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    grown = place < DRAWS + GROWS
    trees = Trees.fit(x[grown], y[grown])
    return Model(words, trees, Isotonic.fit(trees.logit(x[~grown]), y[~grown]))


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    describer = Describer(model.value.lexicon)
    for batch in slices(batches):
        x = np.array([describer.features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
        score = np.clip(model.value.score(x), 0.0, 1.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", labelled: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    ``held_out`` marks rows whose CRC-32 of the key modulo 5 is 0: their labels teach nothing. Only the text makes the score. Null and blank texts have features of
    zero and are scored like others; a null key is not held out and stays; repeated rows give equal answers; without labels all scores are 0; no rows give
    none; further columns play no part, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, labelled))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(remainder(key) == 0, F.lit(False)).alias("held_out"))
    return over_batches(rows, partial(_scored, model=model), f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
