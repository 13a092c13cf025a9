import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import evaluate as E
from dossier.operators import items as I
from dossier.operators import match as M
from dossier.operators import ordered as O
from dossier.operators import outline as L
from dossier.operators import terms as K
from dossier.operators.vectors import top_k


def test_running_is_the_same_for_any_block(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)])) for k in ("a", "b") for i in range(40)]
    d = spark.createDataFrame(rows, "k string, i bigint, v int")
    outs = []
    for block in (3, 7, 65536, None):
        x = O.carry_forward(d, ["k"], ["i"], {"c": F.col("v")}, block)
        x = O.previous(x, ["k"], ["i"], {"p": F.col("v")}, block)
        x = O.following(x, ["k"], ["i"], {"n": F.col("v")}, block)
        x = O.row_index(x, ["k"], ["i"], "r", block)
        x = O.running(x, ["k"], ["i"], {"s": O.Running(F.col("v"), "sum")}, block).withColumn("s", F.coalesce("s", F.lit(0)))
        outs.append(sorted(map(tuple, x.select("k", "i", "c", "p", "n", "r", "s").collect())))
    want, last = [], {}
    for k in ("a", "b"):
        vs = [v for kk, _, v in rows if kk == k]
        total = 0
        for i, v in enumerate(vs):
            last[k] = v if v is not None else last.get(k)
            total += v or 0
            want.append((k, i, last[k], vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None, i, total))
        last.pop(k)
    for got in outs:
        assert got == sorted(want, key=lambda r: r[:2])


def test_running_over_a_hot_key_of_ties(spark):
    """One key and one order value hold most rows: blocks stay small, and results follow one total order."""
    rng = random.Random(2)
    rows = [("hot", 5, rng.choice([None, *range(50)])) for _ in range(300)] + [("hot", n, n) for n in range(9)] + [("cold", n % 2, n) for n in range(20)]
    d = spark.createDataFrame(rows, "k string, i bigint, v int").repartition(5)
    assert O.laid_out(d, ["k"], ["i"]).groupBy("k", F.floor(F.col("__p") / 16)).count().agg(F.max("count")).first()[0] <= 16
    x = O.running(d, ["k"], ["i"], {"s": O.Running(F.col("v"), "sum"), "r": O.Running(F.lit(1), "count"), "c": O.Running(F.col("v"), "last")}, 16)
    x = x.select("*", F.xxhash64("k", "i", "v").alias("h"))
    for key in ("hot", "cold"):
        total, last = 0, None
        got = sorted((r for r in x.where(F.col("k") == key).collect()), key=lambda r: r["r"])
        assert [r["r"] for r in got] == list(range(1, len(got) + 1))
        assert [(r["i"], r["h"]) for r in got] == sorted((r["i"], r["h"]) for r in got)
        for r in got:
            total, last = total + (r["v"] or 0), r["v"] if r["v"] is not None else last
            assert (r["s"], r["c"]) == (total, last)


def test_interval_join_takes_the_first_range(spark):
    rng = random.Random(5)
    ranges = [(1, i, a, a + rng.randint(0, 30), f"r{i}") for i, a in enumerate(rng.randint(1, 100) for _ in range(20))]
    points = [(1, p) for p in range(1, 120)]
    got = O.interval_first(spark.createDataFrame(points, "d int, p int"), spark.createDataFrame(ranges, "d int, o int, s int, e int, id string"), ["d"], "p", "s", "e", "o", ["id"], width=8)
    for r in got.collect():
        assert r.id == next((x[4] for x in ranges if x[2] <= r.p <= x[3]), None)


def test_top_k_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, base[i % 40].tolist()) for i in range(400)] + [(999, [0.0] * 8)]
    d = spark.createDataFrame(rows, "pk bigint, embedding array<float>").repartition(6)
    q = spark.createDataFrame([(i, base[i].tolist()) for i in range(3)], "query_id int, query_vec array<float>")
    got = {}
    for r in top_k(d, q, 15, "pk").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.pk))
    for i in range(3):
        a = base[i].astype(float)
        dist = lambda v: round(1 - float(a @ v) / (np.linalg.norm(a) * np.linalg.norm(v)), 9)
        want = sorted((dist(np.array(v, dtype=float)), pk) for pk, v in rows[:-1])[:15]
        assert [pk for _, pk in sorted(got[i])] == [pk for _, pk in want]


def plain_standard(text, patterns):
    """Match that ends first, longest of those, then on."""
    out, at = [], 0
    for end in range(1, len(text) + 1):
        best = [p for p in patterns if text[:end].endswith(p) and end - len(p) >= at]
        if best:
            p = max(best, key=len)
            out.append(p)
            at = end
    return out


@pytest.mark.parametrize("shard", [100_000, 4])
def test_scan_modes_against_brute_force(spark, shard):
    rng = random.Random(2)
    patterns = ["ab", "abc", "b", "bca", "ca", "cab", "牛肉", "牛肉及", "肉及", "zz"]
    texts = [(i, "".join(rng.choice("abc牛肉及") for _ in range(30))) for i in range(60)]
    p = spark.createDataFrame(list(enumerate(patterns)), "pid bigint, pattern string")
    d = spark.createDataFrame(texts, "i int, t string")
    full = {r.i: r.hits for r in M.scan(d, "t", p, "standard", shard=shard).collect()}
    some = {r.i: r.hits for r in M.scan(d, "t", p, "contains", shard=shard).collect()}
    for i, t in texts:
        assert [patterns[h.pid] for h in full[i]] == plain_standard(t, patterns)
        assert {patterns[h.pid] for h in some[i]} == {x for x in patterns if x in t}
        assert all(t.find(patterns[h.pid]) == h.start for h in some[i])


def _dictionary(spark):
    off = spark.createDataFrame([("牛肉", "beef", 0), ("牛肉及牛肉製品", "beef and beef products", 1), ("豬肉製品", "pork products", 2)], "zh string, en string, ord bigint")
    stems = spark.createDataFrame([("豬肉", "豬肉製品", 0), ("牛肉", "牛肉及牛肉製品", 1), ("羊肉", "羊肉製品", 2)], "stem string, official string, ord bigint")
    return M.dictionary_patterns(M.load_dictionary(off), stems)


def test_dictionary_modes(spark):
    p = _dictionary(spark)
    assert {(r.pattern, r.zh, r.en, r.is_stem) for r in p.collect()} == {
        ("牛肉", "牛肉", "beef", False), ("牛肉及牛肉製品", "牛肉及牛肉製品", "beef and beef products", False),
        ("豬肉製品", "豬肉製品", "pork products", False), ("豬肉", "豬肉製品", "pork products", True), ("羊肉", "羊肉製品", "", True),
    }
    d = spark.createDataFrame([(1, "牛肉及牛肉製品與羊肉")], "id int, t string")
    assert {r.zh for r in M.term_hits(d, ["id"], "t", p, "contains").collect()} == {"牛肉", "牛肉及牛肉製品"}
    assert {(r.zh, r.en) for r in M.term_hits(d, ["id"], "t", p, "standard").collect()} == {("牛肉", "beef"), ("羊肉製品", "")}


def test_grounding_drops_terms_only_a_stem_brought(spark):
    p = _dictionary(spark)
    d = spark.createDataFrame([(1, "請問豬肉", "無關內容"), (2, "請問豬肉", "有豬肉的內容"), (3, "豬肉製品規定", "")], "id int, q string, c string")
    got = {(r.id, r.zh) for r in M.grounded_terms(d, ["id"], "q", "c", p).collect()}
    # question 3 holds the full form, although its stem matched first
    assert got == {(2, "豬肉製品"), (3, "豬肉製品")}


def test_intent_longest_first(spark):
    units = spark.createDataFrame([(0, "A", "a1", "牛肉,豬", None), (1, "B", "b1", "牛肉製品", ["羊"]), (2, "A", "a1", "雞肉類", None)], "ord int, agency string, unit string, keywords string, extended array<string>")
    d = spark.createDataFrame([(1, "牛 肉製品與豬")], "id int, t string")
    got = [(r.rank, r.agency, r.keyword) for r in M.classify(d, ["id"], "t", M.intent_patterns(units), 2, "contains").orderBy("rank").collect()]
    assert got == [(1, "B", "牛肉製品"), (2, "A", "牛肉")]


def test_align(ev):
    got = ev((["a", "b", "c"], ["x", "y"]), lambda c: K.align(c["l"], c["r"]), "struct<l:array<string>,r:array<string>>")
    assert [(r.a, r.b) for r in got] == [("a", "x"), ("b", "x"), ("c", "y")]
    assert ev((["a"], []), lambda c: K.align(c["l"], c["r"]), "struct<l:array<string>,r:array<string>>") is None


def test_majority_first_seen_wins_ties(spark):
    d = spark.createDataFrame([(1, t, i) for i, t in enumerate(["QA", "REGULATION", "REGULATION", "QA"])], "d int, t string, o int")
    assert K.majority(d, "d", "t", "o").first().t == "QA"


def test_batches_cover_every_row(spark):
    d = spark.range(0, 250).withColumnRenamed("id", "o")
    sizes = [r["count"] for r in K.batches(d, "o", 80).groupBy("batch").count().collect()]
    assert sum(sizes) == 250 and max(sizes) <= 80
    rows = L.verification_batches(d.withColumn("doc_id", F.lit(1)), ["doc_id"], ["o"], 80).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in rows] == [80, 80, 80, 10]


def test_page_paths(spark):
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 4)], "doc_id int, page int")
    nodes = spark.createDataFrame([(1, 0, 1, "I"), (1, 1, 3, "II")], "doc_id int, ord bigint, page int, path string")
    assert [r.path for r in L.page_paths(pages, nodes).orderBy("page").collect()] == ["I", "I", "II", "II"]


def test_chunk_paths_with_and_without_nodes(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "h0"), (1, 1, 150, "h1"), (2, 0, 0, "h2"), (2, 1, 9, "h3")], "doc_id int, chunk_idx int, start bigint, heading string")
    nodes = spark.createDataFrame([(1, 0, 0, "I", "I x"), (1, 1, 120, "II", "II y")], "doc_id int, ord bigint, pos bigint, path string, title string")
    for block in (2, None):
        got = [(r.doc_id, r.path) for r in L.chunk_paths(chunks, nodes, block=block).orderBy("doc_id", "chunk_idx").collect()]
        assert got == [(1, "I"), (1, "II"), (2, ""), (2, "h2")]


def test_scores(spark):
    a = spark.createDataFrame([("c", "1", "A b", 0), ("c", "2", "x", 0), ("c", "2", "y", 1), ("c", "9", "z", 0)], "case_id string, question_id string, question_text string, ord int")
    e = spark.createDataFrame([("c", "1", "a-B", 0), ("c", "2", "x", 0), ("c", "3", "q", 0)], "case_id string, question_id string, question_text string, ord int")
    c = E.compared(a, e)
    assert {(r.question_id, r.status) for r in c.collect()} == {("1", "match"), ("2", "text_mismatch"), ("3", "missing"), ("9", "extra")}
    s = E.scores(c).first()
    assert (s.precision, s.recall) == (2 / 3, 2 / 3)
    assert E.summary(E.scores(c), 0.9).first().all_passed is False


def _items(spark, ids, texts=None):
    rows = [(1, i, q, (texts or [f"text {n}" for n in range(len(ids))])[i]) for i, q in enumerate(ids)]
    return spark.createDataFrame(rows, "doc_id int, ord bigint, question_id string, question_text string")


@pytest.mark.parametrize("block", [2, None])
def test_hierarchy_repair(spark, block):
    fix = lambda ids: [r.question_id for r in I.repaired_hierarchy(_items(spark, ids), ["doc_id"], block=block).orderBy("ord").collect()]
    assert fix(["1.1", "(a)", "(b)", "(i)", "1.2"]) == ["1.1", "1.1.a", "1.1.b", "1.1.b.i", "1.2"]
    assert fix(["1", "2"]) == ["1", "1.2"]
    assert fix(["(12)", "i", ".", "(a)", "x"]) == ["(12)", "(12).i", "", "(a)", "(a).x"]


def _fused(spark, ids, texts):
    return [(i.question_id, i.question_text) for i in I.fused(_items(spark, ids, texts), ["doc_id"]).first()["items"]]


def test_fused_items(spark):
    assert _fused(spark, ["1.1", "1.1", "1.2"], ["First page text.", "Second page text.", "x"]) == [("1.1", "First page text. Second page text."), ("1.2", "x")]
    table = '<table border="1"><thead><tr><th>Col1</th></tr></thead><tbody><tr><td>%s</td></tr></tbody></table>'
    one = _fused(spark, ["1.1", "1.1"], ["<p>Table header:</p>" + table % "Row1", table % "Row2"])
    assert len(one) == 1 and one[0][1].count("<table") == 1 and "Row1" in one[0][1] and "Row2" in one[0][1]
    far = _fused(spark, ["1.1", "1.2", "1.3", "1.1"], ["A", "b", "c", "B<p>other</p>"])
    assert [q for q, _ in far] == ["1.1", "1.2", "1.3", "1.1.2"] and far[0][1] == "A"
    orphan = _fused(spark, ["C.B.19", "C.B.20", "C.B.25", "C.B.19"], ["a?", "b", "indicate the following:", table % "verify"])
    assert [q for q, _ in orphan] == ["C.B.19", "C.B.20", "C.B.25"] and "verify" in orphan[2][1]


def test_merged_by_id(spark):
    got = I.merged_by_id(_items(spark, ["1.1", "1.1", "2", "1"], ["First", "Second", "x", "y"]), ["doc_id"]).orderBy("ord").collect()
    assert [(r.question_id, r.question_text) for r in got] == [("1.1", "First Second"), ("2", "x"), ("1", "y")]
    same = I.merged_by_id(_items(spark, ["1", "1"], ["Same text.", "Same  text."]), ["doc_id"]).first()
    assert same.question_text == "Same text."


def test_weak_headings(spark):
    q, h = I.split_weak_headings(_items(spark, ["2.1.3", "2.1.3.1"], ["Storage and transport conditions", "Are temperature logs maintained during storage?"]))
    assert [r.question_id for r in q.collect()] == ["2.1.3.1"]
    assert [r.heading for r in h.collect()] == ["2.1.3 Storage and transport conditions"]


def test_batches_of_dense_and_hashed_orders(spark):
    from dossier.operators import ordered, terms

    dense = spark.range(1000).select(F.col("id").alias("ord"))
    for rows in (dense, dense.select(F.xxhash64("ord").alias("ord"))):
        got = terms.batches(rows.repartition(7), "ord", 90).collect()
        sizes = {}
        for r in got:
            sizes.setdefault(int(r.batch), []).append(r.ord)
        assert [len(sizes[b]) for b in sorted(sizes)] == [90] * 11 + [10]
        assert sorted(r.ord for r in got) == [o for b in sorted(sizes) for o in sorted(sizes[b])]
    assert terms.batches(dense.where("false"), "ord", 90).count() == 0
    assert ordered.BLOCK > 1


def test_nearest_over_several_passes_and_ties(spark, monkeypatch):
    import numpy as np

    from dossier.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES_PER_PASS", 3)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 5))
    rows = [(f"k{i:03d}", [float(x) for x in base[i % 40]], i) for i in range(160)]
    table = spark.createDataFrame(rows, "pk string, embedding array<double>, place int").repartition(5)
    asked = spark.createDataFrame([(q, [float(x) for x in rng.normal(size=5)]) for q in range(10)], "query_id int, query_vec array<double>")
    got = {}
    for r in vectors.top_k(table, asked, 6, "pk", payload=["place"]).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.pk, r.place))
    for q in asked.collect():
        v = np.array(q.query_vec)
        best = sorted((round(float(1 - np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 9), k, i) for k, x, i in rows)[:6]
        assert [(k, i) for _, k, i in sorted(got[q.query_id])] == [(k, i) for _, k, i in best]
