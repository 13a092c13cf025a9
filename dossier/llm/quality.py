"""Quality classifier: document evidence and site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import content_of, fresh_name, over_batches, same, slices, stored

#: Labelled documents that the document classifier is fitted on, at most (chosen by hash); words of its lexicon, at most.
LABELLED, LEXICON = 20_000, 2_000
#: Toxic documents that a lexicon word must occur in: so many, and this share of them; standard deviations of its log odds from zero.
LEXICON_DOCS, LEXICON_SHARE, LEXICON_Z = 3, 0.02, 3.3
#: Least lower bound of the log odds of a lexicon word.
LEXICON_WEIGHT = 1.0
#: Openings of words that stand in the lexicon like words do.
STEMS = (4, 5)
#: Ridge of the logistic fit, and its Newton steps.
RIDGE, STEPS = 3.0, 30
#: Bounds of a site's prior strength in documents.
WEAKEST, STRONGEST = 1.0, 1e6
#: Site rows that may be broadcast; beyond it the join is left to shuffle.
SITES_BROADCAST = 200_000

#: Shape of a text, whatever its language and words; and how it meets the lexicon.
SHAPE = ("length", "upper", "symbol", "bar", "distinct", "repeated", "line_repeat", "sentence_repeat", "longest_word")
MEETING = ("toxic_sum", "toxic_max", "toxic_share")
FEATURES = SHAPE + MEETING

# classes of bytes: 1 upper, 2 lower, 3 digit, 4 space, 5 full stops and commas, 6 other ASCII marks, 7 beyond ASCII
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = 6
_CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("a"):ord("z") + 1], _CLASS[ord("0"):ord("9") + 1] = 1, 2, 3
_CLASS[list(b" \t\n\r\x0b\x0c")], _CLASS[list(b".,;'\"()-")], _CLASS[0x80:] = 4, 5, 7
_TRIM = re.compile(r"^\W+|\W+$")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def marks_of(kinds: set[str]) -> set[str]:
    """What can stand in the lexicon: words without marks around them, and the openings of longer ones."""
    bare = {w if w.isalnum() else _TRIM.sub("", w) for w in kinds}
    return bare.union(*({f"{w[:n]}*" for w in bare if len(w) > n} for n in STEMS)) - {""}


def describe(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """FEATURES of a whole text. A null or blank text has zeros, and a length of zero."""
    words = words_of(text) if text else []
    if not words:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(_CLASS[data], minlength=8)
    size, n = len(data), len(words)
    kinds = set(words)
    repeated = sum(map(str.__eq__, words, words[1:]))
    lines = [line for line in text.split("\n") if line]
    sentences = [s for s in re.split(r"[.!?\n]+", text) if len(s) > 20]
    weights = [lexicon[w] for w in marks_of(kinds) & lexicon.keys()] if lexicon else []
    return [
        float(np.log1p(n)), counts[1] / size, counts[6] / size, data.tobytes().count(b"|") / size, len(kinds) / n ** 0.8, repeated / n,
        1 - len(set(lines)) / max(len(lines), 1), 1 - len(set(sentences)) / max(len(sentences), 1), float(np.log1p(max(map(len, kinds)))),
        min(sum(weights), 20.0), max(weights, default=0.0), sum(weights) / n ** 0.5,
    ]


@dataclass(frozen=True)
class Logistic:
    """Weights on standardised features and their squares."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @staticmethod
    def _shape(features: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
        z = np.clip((features - centre) / spread, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, np.minimum(z * z, 16)], axis=1)

    @classmethod
    def fit(cls, features: np.ndarray, target: np.ndarray) -> Logistic:
        centre, spread = features.mean(axis=0), features.std(axis=0)
        spread = np.where(spread > 1e-9, spread, 1.0)
        x = cls._shape(features, centre, spread)
        weights = np.zeros(x.shape[1])
        # a label with no example of its own still has a finite rate
        rate = (target.sum() + 0.5) / (len(target) + 1)
        weights[0] = np.log(rate / (1 - rate))
        ridge = np.full(x.shape[1], RIDGE)
        ridge[0] = 1e-3
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (p - target) + ridge * (weights - np.eye(1, x.shape[1])[0] * weights[0])
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
            weights = weights - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        return cls(centre, spread, weights)

    def logit(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self._shape(features, self.centre, self.spread) @ self.weights, -12, 12)


@dataclass(frozen=True)
class Model:
    """Document classifier: how likely a document is of good quality, and how likely it is toxic."""

    lexicon: dict[str, float]
    good: Logistic | None
    toxic: Logistic | None
    base_rate: float

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of being good, and of being toxic."""
        features = np.array([describe(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        if self.good is None or self.toxic is None:
            return np.full(len(texts), self.base_rate), np.zeros(len(texts))
        good, toxic = (1 / (1 + np.exp(-m.logit(x))) for m, x in ((self.good, features[:, :len(SHAPE)]), (self.toxic, features[:, len(SHAPE):])))
        return np.clip(good, 1e-5, 1 - 1e-5), toxic


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and openings of every labelled text with the label."""
    for batch in slices(batches, 64):
        words, toxic = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            marks = marks_of(set(words_of(text or "")))
            words += marks
            toxic += [label] * len(marks)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], ["word", "toxic"])


def _described(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        features = [describe(t, lexicon) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.float64())), batch.column(2), batch.column(3)], ["doc_id", "features", "good", "toxic"])


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and openings that mark toxic documents, with the lower bound of their log odds; LEXICON of them at most."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    toxic = float(totals["toxic"] or 0)
    other = float(totals["n"]) - toxic
    found = over_batches(sample.select("text", F.col("toxic").cast("long").alias("toxic")), _words, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (toxic + 1)) - F.log(b / (other + 1))
    deviation = F.sqrt(1 / a + 1 / b)
    kept = found.where((F.col("a") >= LEXICON_DOCS) & (F.col("a") >= LEXICON_SHARE * toxic)).select("word", (odds - 2 * deviation).alias("weight"), (odds / deviation).alias("z"))
    kept = kept.where((F.col("z") >= LEXICON_Z) & (F.col("weight") > LEXICON_WEIGHT))
    return {r["word"]: float(r["weight"]) for r in kept.orderBy(F.desc("weight"), "word").limit(LEXICON).collect()}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Document classifier of at most LABELLED labelled documents, chosen by the hash of their key.

    The lexicon of toxic words is drawn from one half of the sample, so that what it says on the other half is honest for the fit.
    Labels that are null or of null keys play no part; of several labels of one key the worst counts. Without labels every document has the rate 0.5.
    """
    marked = labels.where(f"{key} IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic"))
    n = marked.count()
    share = min(1.0, LABELLED / max(n, 1))
    # the same share of the range of a 64-bit hash
    chosen = marked.where(F.xxhash64("_key") < int((2 * share - 1) * 2**63)) if share < 1 else marked
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    found = narrow.join(F.broadcast(chosen), "_key").select(F.col("_key").alias("doc_id"), "text", "good", "toxic")
    # copies of a text count once, or their words would look like marks of their label
    once = found.where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("good").alias("good"), F.max("toxic").alias("toxic"))
    sample = stored(once.select("doc_id", "text", "good", "toxic"), "labelled")
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    lexicon = _lexicon(sample.where(half))
    rows = over_batches(sample, partial(_described, lexicon=lexicon), "doc_id " + sample.schema["doc_id"].dataType.simpleString() + ", features array<double>, good " + sample.schema["good"].dataType.simpleString() + ", toxic " + sample.schema["toxic"].dataType.simpleString())
    rows = sorted(((r["doc_id"], list(r["features"]), float(r["good"] > 0), float(r["toxic"] > 0)) for r in rows.collect()), key=lambda r: (r[0], r[1]))
    if not rows:
        return Model(lexicon, None, None, 0.5)
    features, good, toxic = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    rate = float(good.sum() + 0.5) / (len(rows) + 1)
    return Model(lexicon, Logistic.fit(features[:, :len(SHAPE)], good), Logistic.fit(features[:, len(SHAPE):], toxic), rate)


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        doc, toxic = model.value.score(batch.column(3).to_pylist())
        columns = [*batch.columns[:3], pa.array(doc), pa.array(toxic), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "path", "doc_score", "toxic_score", *batch.schema.names[4:]])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _prior(groups: DataFrame, mean: Column) -> float:
    """Strength, in documents, of the prior that the groups (columns n and s) share, by moments; ``mean`` is each group's prior rate.

    The groups' rates spread by chance alone, n * mean * (1 - mean), and by their own differences; the more of the latter, the weaker the prior.
    """
    n, rate = F.col("n"), F.col("s") / F.col("n")
    within = mean * (1 - mean)
    row = groups.agg(F.sum(n * (rate - mean) * (rate - mean)).alias("seen"), F.sum(within).alias("chance"), F.sum((n - 1) * within).alias("room")).first()
    if not row["room"] or row["room"] <= 0:
        return STRONGEST
    share = (row["seen"] - row["chance"]) / row["room"]
    return min(max(1 / share - 1, WEAKEST), STRONGEST) if share > 0 else STRONGEST


def posteriors(scores: DataFrame) -> tuple[DataFrame, float]:
    """``host, path, site_rate, site_n`` and the global rate, from ``host, path, evidence`` of all documents.

    Evidence is a label where there is one, else the classifier's probability. Counts and sums are aggregated by (host, path), hosts from those rows, and the
    rest from hosts, so no step sees documents again. A host's rate is shrunk toward the global one, a path's toward its host's, each by the
    strength that the spread of such rates shows.
    """
    paths = stored(scores.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        return paths.select("host", "path", F.lit(0.5).alias("site_rate"), F.lit(0).cast("long").alias("site_n")), 0.5
    overall = min(max(total["s"] / total["n"], 1e-4), 1 - 1e-4)
    strength = _prior(hosts, F.lit(overall))
    shrunk = hosts.select(F.col("host").alias("_host"), ((F.col("s") + strength * overall) / (F.col("n") + strength)).alias("host_rate"))
    nested = stored(paths.join(shrunk, same(F.col("host"), F.col("_host"))).drop("_host"), "nested")
    below = _prior(nested, F.col("host_rate"))
    rate = (F.col("s") + below * F.col("host_rate")) / (F.col("n") + below)
    return nested.select("host", "path", rate.alias("site_rate"), F.col("n").cast("long").alias("site_n")), overall


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.5, toxic_limit: float = 0.7, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, host, path, doc_score, toxic_score, site_rate, site_n, score, accepted`` of every row.

    The document's odds of being good are multiplied by how much its site's posterior odds differ from the global ones; a document is accepted at
    ``threshold``, unless it is toxic by ``toxic_limit`` or more. A site with few documents has nearly the global rate, so it moves nothing.

    A null or blank text has no evidence of its own but its emptiness (all features zero). Null hosts and paths are sites of their own. Repeated rows give repeated
    rows with equal answers; null keys stay; no rows give none; other columns play no part. Columns of ``docs`` in ``carried`` are handed through.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text))
    rows = docs.select(F.col(key).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"), *carried)
    kinds = ", ".join([f"doc_id {docs.schema[key].dataType.simpleString()}, host string, path string, doc_score double, toxic_score double", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried)])
    scored = stored(over_batches(rows, partial(_scored, model=model), kinds), "scores")
    known = labels.where("quality IS NOT NULL").groupBy(F.col(key).alias("_key")).agg(F.min((F.col("quality") > 0).cast("double")).alias("label"))
    evidence = scored.join(known, scored["doc_id"] == known["_key"], "left").select("host", "path", F.coalesce("label", "doc_score").alias("evidence"))
    sites, overall = posteriors(evidence)
    sites = stored(sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "site_rate", "site_n"), "sites")
    if sites.count() <= SITES_BROADCAST:
        sites = F.broadcast(sites)
    joined = scored.join(sites, same(F.col("host"), F.col("_host")) & same(F.col("path"), F.col("_path"))).drop("_host", "_path")
    logit = _logit(F.col("doc_score")) + _logit(F.greatest(F.least("site_rate", F.lit(1 - 1e-4)), F.lit(1e-4))) - _logit(F.lit(overall))
    score = 1 / (1 + F.exp(-logit))
    return joined.withColumn("score", score).withColumn("accepted", (F.col("score") >= threshold) & (F.col("toxic_score") < toxic_limit))


def keep_accepted(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are accepted, with all their columns.

    What is decided of a row follows from its text, host and path, so rejected rows are known by these (the text by its SHA-256) and never by their key.
    """
    content = fresh_name(docs, "content")
    marked = docs.withColumn(content, content_of(text))
    rejected = classify(marked, labels, host, path, key, text, carried=(content,)).where("NOT accepted")
    rejected = stored(rejected.select(F.col(content).alias("_content"), F.col("host").alias("_host"), F.col("path").alias("_path")).distinct(), "rejected")
    equal = (marked[content] == rejected["_content"]) & same(host.cast("string"), rejected["_host"]) & same(path.cast("string"), rejected["_path"])
    return marked.join(rejected, equal, "left_anti").select(*docs.columns)
