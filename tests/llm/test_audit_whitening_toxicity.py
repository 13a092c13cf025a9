"""Filter audit, whitening and toxicity: against plain readings of their contracts, and on odd rows."""

import math
import os
import time
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import audit, decontaminate, licenses, qd, quality, queries, secrets, toxicity, warc, whitening
from dossier.llm.shared import alnum_words

DATA = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def fails(text):
    words = [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]
    return {n for n, bad in (("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)),
                             ("D", any(c in "#$%&*|" for c in text))) if bad}


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    rows = []
    for doc_id, text, lang in docs:
        failed = fails(text or "")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in docs):
            failed.add("E")
        good = any(i == doc_id and q == 1 for i, q, _ in labels) and doc_id is not None
        toxic = any(i == doc_id and x == 1 for i, _, x in labels) and doc_id is not None
        rows.append((lang or "", failed, good, toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                failing = [r for r in rows if r[0] == part and name in r[1]]
                shapley[part, name] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {name} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


LONG = " ".join(f"word{i}" for i in range(120))
AUDITED = [(1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, None, "en"), (4, "", None), (5, "SHOUT # now", "de"), (None, LONG, "de"), (None, "", "de"), (6, "a " * 150_000, "de"),
           (7, f"{LONG} $", "en"), (7, "x y", "en"), (8, "\x0b \t", "")]


def test_audit_equals_a_plain_reading(spark):
    extra = "row string, content string, part string, prefix string, filter string"
    docs = spark.createDataFrame([(*r, "1", "2", "3", "4", "5") for r in AUDITED], f"doc_id long, text string, lang string, {extra}")
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (7, None, 1), (5, 1, None), (99, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, part string")
    got = audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == plain_audit(AUDITED, marks)
    assert audit.audit(docs.where("false"), labels).count() == 0
    assert audit.audit(docs, labels.where("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


@pytest.mark.parametrize("case", ["gauss", "graded", "few", "equal", "tied", "close", "none", "one", "mixture"])
def test_singular_values_and_vectors(case):
    draw = np.random.default_rng(2)
    turn = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    rows = {
        "gauss": draw.standard_normal((300, 40)), "graded": draw.standard_normal((300, 40)) * np.logspace(0, -10, 40), "few": draw.standard_normal((7, 40)), "equal": np.ones((50, 40)),
        "tied": turn * np.repeat([1, 2, 3, 4], 10) @ turn.T, "close": turn * (1 + 1e-9 * np.arange(40)) @ turn.T, "none": np.zeros((50, 40)), "one": np.array([[3.0]]),
        "mixture": draw.standard_normal((5, 40))[draw.integers(0, 5, 900)] + 0.01 * draw.standard_normal((900, 40)),
    }[case]
    r = np.linalg.qr(np.vstack([rows, np.zeros((rows.shape[1], rows.shape[1]))]), mode="r")
    values, vectors = qd.right_vectors(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    largest = max(want.max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * largest
    if case == "graded":
        assert np.abs(values / want - 1).max() < 1e-12
    sound = values > 1e-18 * largest
    assert np.abs(r.T @ r @ vectors - vectors * values).max() <= 1e-12 * largest
    assert np.abs(vectors[:, sound].T @ vectors[:, sound] - np.eye(sound.sum())).max(initial=0) < 1e-9


def plain_whitening(rows, k=16):
    sound = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.unique(np.array([v for _, v in sound]), axis=0)
    n, s = len(x), x.sum(axis=0)
    e, u = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, v in sound:
        out.setdefault(i, []).append((n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)), np.abs((np.array(v) - s / n) @ u / np.sqrt(e)), e / np.linalg.eigh((x - s / n).T @ (x - s / n) / n)[0].sum()))
    return out


def held(rows):
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    return got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_whitening_of_a_whole_table(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, got = plain_whitening(vectors), held(queries.QUERIES["op12_whitening"](spark, DATA).collect())
    assert want.keys() == got.keys()
    for i, [(n, deviation, white, explained)] in want.items():
        rows = [got[i][c][0] for c in range(1, 17)]
        assert {(r["n"], r["deviation"]) for r in rows} == {(n, deviation)}
        assert np.allclose(np.abs([r["whitened"] for r in rows]), white, atol=1e-8) and np.allclose([r["explained"] for r in rows], explained, rtol=1e-9)
        assert rows[0]["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(1)
    base = [(i, [float(c) for c in v]) for i, v in enumerate(draw.standard_normal((30, 4)))]
    odd = [(None, base[0][1]), (40, base[1][1]), (40, base[1][1]), (41, None), (42, []), (43, [1.0, None, 2.0, 3.0]), (44, [1.0, math.nan, 2.0, 3.0]), (45, [1.0, math.inf, 0.0, 0.0]), (46, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, n string, component string"
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in base + odd], schema)
    got, want = held(whitening.whiten(df).collect()), plain_whitening([(i, v and list(np.float32(c) for c in v)) for i, v in base])
    assert got.keys() == {None, 40, *range(30)} and len(got[40][1]) == 2 and set(got[3]) == {1, 2, 3, 4}
    assert all(np.isclose(abs(got[i][c][0]["whitened"]), want[i][0][2][c - 1]) for i in range(30) for c in range(1, 5))
    for nothing in (df.where("false"), df.where("vec_id = 41"), df.where("vec_id = 40")):
        assert whitening.whiten(nothing).count() == 0
    flat = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [3.0, 1.0])], "vec_id int, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 5.0]), (3, [-1e300, 1.0])], "vec_id int, embedding array<double>")
    # entries count as BOUND, their deviations fit no long, and the other direction is flat beside them
    assert [r["deviation"] is None for r in sorted(whitening.whiten(huge).collect())] == [True, False, True]


def test_triangles_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    draw = np.random.default_rng(1)
    x = draw.integers(-50, 50, (90, 5)).astype("<i8")
    fit = spark.createDataFrame([(v.tobytes(),) for v in x], "x binary").repartition(9)
    r = whitening.triangle(fit, 5, x.mean(axis=0))
    assert np.allclose(r.T @ r, np.cov(x.T, bias=True) * 90)


INSULTS = "grobbler mulfink snarvet".split()


def posts(n, seed):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"plain{int(w)}" for w in draw.integers(0, 400, int(draw.integers(5, 60)))]
        toxic = bool(draw.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(int(draw.integers(0, len(words))), str(draw.choice(INSULTS)))
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = posts(1_500, 3)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    truth = {i: x for i, _, x in rows}
    held_out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held_out) >= 0.97 * len(held_out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    # labels of held-out rows, and columns but the text, teach nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, toxicity.score(moved, flipped).collect())) == sorted(map(tuple, got))


def test_toxicity_of_odd_rows(spark):
    texts = [None, "", " \n", "You GROBBLER!!! " * 30_000, "gr0bbler", "😀 ok"]
    rows = posts(300, 4)
    schema = "doc_id long, text string, toxic string, good string, _key string, _toxic string, place string, held_out string"
    docs = spark.createDataFrame([(i, t, *"abcdef") for i, t, _ in rows] + [(1000 + i, t, *"abcdef") for i, t in enumerate(texts)] + [(None, "grobbler", *"abcdef")] * 2, schema)
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows] + [(None, 1), (1000, None), (1001, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and [r["held_out"] for r in got if r["doc_id"] is None] == [False, False]
    assert len({r["score"] for r in got if r["doc_id"] in (1000, 1001, 1002)}) == 1
    assert toxicity.score(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.where("false")).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, one, labelled=50).collect())


def test_hidden_words_count_and_steps_rise():
    lexicon = {"grobbler": 5.0}
    seen = dict(zip(toxicity.FEATURES, toxicity.Describer(lexicon).features("you gr0bbler, my GROBBLER!!!")))
    assert seen["obfuscated"] == 1 and seen["near_second"] == 2 and seen["lexicon_max"] == 5.0
    draw = np.random.default_rng(0)
    score = draw.standard_normal(500)
    fitted = toxicity.Isotonic.fit(score, (draw.random(500) < 1 / (1 + np.exp(-2 * score))).astype(float))
    assert (np.diff(fitted(np.linspace(-4, 4, 99))) >= 0).all() and 0 < fitted.value.min() and fitted.value.max() < 1


@pytest.mark.parametrize("unit", ["eyJ-", "eyJaaaaaaaa.", "token ", "<a", "<a '", "<script ", "<!", "a", "a b "])
def test_repetitive_texts_end_in_time(unit):
    text = unit * (1_000_000 // len(unit))
    tests = decontaminate.Suffixes([("i", [b"a"] * 400), ("k", alnum_words("b a " * 200))])
    start = time.perf_counter()
    secrets.find(text)
    warc.convert(text)
    decontaminate._of_shard(tests, [alnum_words(text)])
    licenses.Scanner().scan("Permission is hereby granted free of charge to x " * 20_000)
    assert time.perf_counter() - start < 20


def test_longest_matches_equal_a_plain_search():
    draw = np.random.default_rng(8)
    for _ in range(60):
        letters = "abcdef"[: int(draw.choice([1, 2, 3, 6]))]
        text = lambda sizes: " ".join(draw.choice(list(letters), int(draw.choice(sizes))))  # noqa: B023, E731
        items = sorted((str(i), alnum_words(text([1, 3, 9, 10, 11, 15, 30]))) for i in range(3))
        words = alnum_words(text([0, 1, 5, 10, 12, 40, 90]))
        row = decontaminate._of_shard(decontaminate.Suffixes(items), [words])[0]
        best = (0, None, None)
        for name, own in items:
            for a in range(len(words)):
                for b in range(len(own) if len(own) >= 10 else 1):
                    n = 0
                    while a + n < len(words) and b + n < len(own) and words[a + n] == own[b + n]:
                        n += 1
                    if n >= min(10, len(own)) and (n, -a) > (best[0], -(best[2] if best[2] is not None else 10**9)):
                        best = (n, name, a)
        assert (row[4], row[5], row[6]) == best


def test_clashing_columns(spark, tmp_path):
    rows = posts(200, 5)
    names = "toxic string, good string, _key string, _spans string, _digest string, score string, content string, _content string"
    docs = spark.createDataFrame([(i, t + (" password = hunter2hunter2" if i == 3 else ""), *"abcdefgh") for i, t, _ in rows], f"doc_id long, text string, {names}")
    labels = spark.createDataFrame([(i, int(not x), int(x)) for i, _, x in rows], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels, F.lit("h"), F.lit("p")).count() == 200
    assert quality.keep_accepted(docs, labels, F.lit("h"), F.lit("p")).columns == docs.columns
    masked = secrets.mask(docs, str(tmp_path / "ledger"))
    assert masked.columns == docs.columns
    assert masked.where("doc_id = 3").first()["text"].endswith("[secret]") and masked.where("doc_id = 3").first()["_spans"] == "d"
