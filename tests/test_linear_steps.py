"""Steps that must look at each row once: results of the short ways, and plans without the repeated work."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier import models
from dossier.functions import html as H
from dossier.functions import ids
from dossier.functions import text as T
from dossier.operators import items as I
from dossier.operators import match as M
from dossier.operators import numbering as N
from dossier.operators import vectors as V
from dossier.plans import breakdown as B
from dossier.plans import ingest as G

TABLE = "**7. Questions**\n| No | Detailed questions |\n| --- | --- |\n| 1 | one |\n| 2 | *two*  words |\n| 2.1 | three |"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_structured_questions_read_documents_once(spark):
    docs = spark.createDataFrame([(1, TABLE), (2, TABLE.replace("Detailed", "Other")), (3, None), (None, TABLE)], "doc_id long, text string")
    found = N.structured_questions(docs)
    assert sorted((r.doc_id, r.question_id, r.question_text) for r in found.collect()) == [(1, "7.1", "one"), (1, "7.2", "two words"), (1, "7.2.2.1", "three")]
    assert "Join" not in plan(found)


def test_long_documents_are_not_cut_in_a_filter(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(B, "skeleton", lambda docs, model: taken.append(docs) or spark.createDataFrame([], "doc_id bigint, ord bigint, pos bigint, path string, title string"))
    docs = spark.createDataFrame([(1, "# A\n" + "x" * 4000 + "\n# B\n" + "y" * 4000), (2, "# A\nshort")], "doc_id long, text string")
    B.breakdown_v2(docs, models.EchoItems(), models.EchoItems())
    assert {r.doc_id: r.text is None for r in taken[0].collect()} == {1: False, 2: True}
    assert "Filter" not in plan(taken[0])


def test_text_behind_an_id_is_found_without_a_pattern_of_the_id(ev):
    cut = lambda qid, text: ev(text, lambda c: H.without_id_prefix(F.lit(qid), c))
    assert cut(r"A\E.1", r"A\E.1: why?") == "why?"
    assert cut("Part a.3", "PART A.3 - why?") == "why?"
    assert cut("Part a.3", "A.3) why?") == "A.3) why?"
    assert cut("1.b", "(B) why?") == "why?"
    assert cut("1.b", "b. why?") == "why?"
    assert cut("x", "x") == "x"
    assert cut("x", "Q 4: why?") == "why?"
    assert cut("1.2", "<p><b>1.2</b> why?") == "<p>why?"


def test_ids_and_cells(ev):
    assert ev(" Part_A . 3__b_", ids.normalize_question_id) == "Part A.3.b"
    assert ev("part  b  12", ids.normalize_question_id) == "part  b.12"
    assert ev(" 　| a*  b |  | c |x", H.table_cells, "string") == ["a b", "c"]
    assert ev("a | b |", H.table_cells) == []
    assert ev("  \x1cx y\x85", T.strip) == "x y"
    assert [ev(x, T.has_english) for x in ("a1b2c", "ab é", "")] == [True, False, False]


def test_hits_and_segments_of_a_batch_in_slices(spark, monkeypatch):
    rows = [(i, "alpha beta" if i % 2 else None) for i in range(2 * M._TEXTS + 3)]
    patterns = spark.createDataFrame([(7, "alpha"), (9, "beta")], "pid long, pattern string")
    found = M.hit_rows(spark.createDataFrame(rows, "k long, t string").coalesce(1), ["k"], "t", patterns, "standard").collect()
    assert sorted((r.k, r.pid, r.start, r.stop) for r in found) == sorted((i, *h) for i, t in rows if t for h in ((7, 0, 5), (9, 6, 10)))
    pages = pa.array(["<p>a</p>b" if i % 3 else None for i in range(2 * H._PAGES + 1)])
    assert H.html_segments.func(pages).to_pylist() == [["a", "b"] if i % 3 else [] for i in range(len(pages))]


def test_matches_are_sorted_in_many_pieces(spark):
    asked = spark.createDataFrame([(1, "alpha beta"), (1, "beta"), (None, "alpha")], "k long, t string").coalesce(1)
    patterns = spark.createDataFrame([(7, "alpha", "A", "u"), (9, "beta", "B", "v")], "pid long, pattern string, agency string, unit string")
    ranked = M.classify(asked, ["k"], "t", patterns, 2)
    assert sorted(((r.k or 0), r.agency, r.rank) for r in ranked.collect()) == [(0, "A", 1), (1, "A", 1), (1, "B", 2)]
    assert "RepartitionByExpression" in plan(ranked)


def test_headers_are_cleaned_with_their_text(spark):
    rows = spark.createDataFrame([("p", "x"), ("x", "x y"), ("", "x")], "p string, c string")
    both = rows.select(G.headed(F.col("p"), F.col("c")).alias("a"), G.with_header(F.col("p"), F.col("c")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] == ["[p]\nx", "x y", "x"]


def test_joined_texts_keep_the_collapsed_form(ev):
    join = lambda texts: ev(texts, I.joined_texts, "array<string>")
    assert join(["a  b", "b", " c ", "b c", "d\te", "c d"]) == "a  b  c d\te"
    assert join([" ", "a", "a"]) == "a"


def test_grounded_terms_read_both_texts_in_one_pass(spark):
    patterns = spark.createDataFrame([(1, "alphabet", "alphabet", "A", False), (2, "alpha", "alphabet", "A", True), (3, "beta", "beta", "B", False)], "pid long, pattern string, zh string, en string, is_stem boolean")
    texts = spark.createDataFrame([(1, "alpha", "x"), (2, "alphabet", "x"), (3, "alpha", "my alpha"), (4, "beta", None), (None, "beta", "beta")], "k long, q string, c string")
    found = M.grounded_terms(texts, ["k"], "q", "c", patterns, "standard")
    assert sorted(map(tuple, found.collect())) == [(2, "alphabet", "A", 0), (3, "alphabet", "A", 0), (4, "beta", "B", 0)]
    assert plan(found).count("Generate ") == 1


def test_ask_pipeline_makes_its_vectors_once(spark, monkeypatch):
    from dossier.catalog import Tables, pipelines

    seen = []
    monkeypatch.setattr(pipelines.A, "ask", lambda asked, corpus, *a, **k: seen.append(corpus.chunks) or {"answers": asked.selectExpr("query_id", "'' AS prompt", "'' AS english", "'' AS chinese_answer")})
    monkeypatch.setattr(pipelines.matching, "_dictionary", lambda t: spark.createDataFrame([("alpha", "A", 1)], "zh string, en string, ord long"))
    monkeypatch.setattr(pipelines.matching, "_stems", lambda t: None)
    monkeypatch.setattr(pipelines.matching, "_units", lambda t: spark.createDataFrame([(1, "a", "u", "k", ["x"])], "ord long, agency string, unit string, keywords string, extended array<string>"))
    t = Tables.__new__(Tables)
    t.documents = spark.createDataFrame([(1, "alpha " * 200, "en", "s")], "doc_id long, text string, lang string, source string")
    t.conversations = spark.createDataFrame([(1, 0, "user", "alpha?")], "conv_id long, turn int, role string, text string")
    pipelines.ask_pipeline(t)
    assert "Eval" not in plan(seen[0]) and seen[0].count() == 3


def test_thousands_of_questions_take_one_pass_over_the_vectors(spark):
    rng = np.random.default_rng(4)
    base, asked = rng.normal(size=(60, 6)), rng.normal(size=(2_500, 6))
    table = spark.createDataFrame([(f"k{i:03d}", x.tolist()) for i, x in enumerate(base)], "pk string, embedding array<double>").repartition(3)
    found = V.top_k(table, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id int, query_vec array<double>"), 4, "pk")
    assert plan(found).count("MapInArrow") == 1
    cosine = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (base / np.linalg.norm(base, axis=1)[:, None]).T
    want = {(i, r + 1, f"k{n:03d}") for i, order in enumerate(np.argsort(-cosine, axis=1)[:, :4]) for r, n in enumerate(order)}
    assert {(r.query_id, r["rank"], r.pk) for r in found.collect()} == want


@pytest.mark.parametrize("size", [7, 100, 1_000])
def test_nearest_rows_that_single_precision_cannot_tell_apart(size, monkeypatch):
    for name, value in (("ROWS", 50), ("QUERIES", 4), ("FIRST", 20), ("EXACT", 16)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(6)
    query = rng.normal(size=(9, 8))
    # rows some 1e-8 from each other, copies of a row, rows without a direction that can be told
    data = np.concatenate([query[0] + rng.normal(size=(300, 8)) * 1e-4, np.repeat(rng.normal(size=(2, 8)) + query[1:3], 150, axis=0), rng.normal(size=(200, 8)), np.full((30, 8), np.nan)])
    data[805] = np.inf
    data = data[rng.permutation(len(data))] * 10.0 ** rng.integers(-20, 20, (len(data), 1))
    names = [f"k{n}" for n in rng.permutation(len(data))]
    unit = query / np.linalg.norm(query, axis=1)[:, None]
    near = V._Nearest(unit, 12, "pk")
    near.most = 200
    for at in range(0, len(data), size):
        near.add(data[at:at + size], pa.table({"pk": names[at:at + size]}))
    asked, rows = near.best()
    got = sorted(zip(asked.tolist(), rows["distance"].to_pylist(), rows["pk"].to_pylist()))
    with np.errstate(invalid="ignore"):
        distance = np.round(1 - (data @ unit.T) / np.linalg.norm(data, axis=1)[:, None], 9)
    want = [(q, d, pk) for q in range(9) for d, pk in sorted((d, pk) for d, pk in zip(distance[:, q].tolist(), names) if d == d)[:12]]
    assert [(q, pk) for q, _, pk in got] == [(q, pk) for q, _, pk in want]
    assert np.allclose([d for _, d, _ in got], [d for _, d, _ in want], atol=1e-9, rtol=0)
