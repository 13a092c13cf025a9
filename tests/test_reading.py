import glob
import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from scripted import Looker, Scripted

from dossier import models
from dossier.functions import pagereading as P
from dossier.plans import reading as R
from dossier.session import shared_folder
from dossier.streaming import reading as stream


def asks(*ids):
    return [{"question_id": i, "question_text": f"Please describe {i} fully"} for i in ids]


def pages_of(spark, docs):
    return spark.createDataFrame([(d, p, image) for d, pages in docs.items() for p, image in pages.items()], "doc_id bigint, page int, image string")


def test_pages_asked_for_are_the_ones_shown(spark):
    first = {f"p{n}": {"extracted_questions": asks(f"A.{n}"), "pending_context": f"rest {n}"} for n in range(1, 9)}
    first["p9"] = {"extracted_questions": asks("A.9"), "request_back_read": True, "back_read_pages": [2, "5", 5, 9, 12, None, "x"]}
    docs = {1: {n: f"p{n}" for n in range(1, 10)}, 2: {1: "p1", 2: "p2"}}
    rows = {(r.doc_id, r.page): r for r in R.read_pages(pages_of(spark, docs), Scripted(first, {"p9": {"extracted_questions": asks("A.8b", "A.9")}})).collect()}
    assert len(rows) == 11
    last = rows[1, 9]
    said = json.loads(last.pending)
    assert said["shown"] == ["p2", "p5", "p9"] and last.back_read == [2, 5]
    assert "<History_Page_2>" in said["prompt"] and "['A.5']" in said["prompt"] and "rest 5" in said["prompt"] and "page 9 of 9" in said["prompt"]
    assert [q["question_id"] for q in json.loads(last.answer)] == ["A.8b", "A.9"]
    assert rows[2, 2].back_read == []


@pytest.mark.parametrize("bad", [
    {"back_read_pages": 2, "request_back_read": True}, {"extracted_questions": 5}, {"extracted_questions": [1, None, "x"]}, "not json", "[1, 2]", {"detected_new_chapters": [3, {"id": 4}]},
    {"back_read_pages": [1e400, {}, []], "request_back_read": True},
])
def test_malformed_answers_end_no_task(spark, bad):
    good = {"extracted_questions": asks("A.1")}
    docs = {1: {1: "p1", 2: "bad", 3: "p1"}, 2: {1: "p1"}}
    rows = R.read_pages(pages_of(spark, docs), Scripted({"p1": good, "bad": bad})).collect()
    assert sorted((r.doc_id, r.page) for r in rows) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert all(json.loads(r.answer) == good["extracted_questions"] for r in rows if r.page != 2)


def test_outlines_with_odd_entries(spark):
    outline = spark.createDataFrame([(1, json.dumps([3, None, {"section_id": "B", "page": "x"}, {"section_id": "A", "page": 2}])), (2, "no json"), (3, '{"a": 1}')], "doc_id bigint, outline string")
    docs = {d: {1: "p1", 2: "p1"} for d in (1, 2, 3, 4)}
    rows = R.read_pages(pages_of(spark, docs), Scripted({"p1": {"extracted_questions": asks("A.1")}}), outline).orderBy("doc_id", "page").collect()
    assert rows[0].sections == ["B", "A"] and [r.sections for r in rows[2:]] == [["General"]] * 6


class Contents:
    """Names a section a page that it is shown, and one that every slice repeats."""

    def __call__(self, prompts, images):
        return [json.dumps([{"section_id": "A", "page": 1}, *({"section_id": x.upper(), "page": int(x[1:])} for x in shown if x != "p1")]) for shown in images]


def test_contents_of_all_pages_come_in_slices(spark):
    docs = {1: {n: f"p{n}" for n in range(1, 8)}, 2: {1: "p1"}}
    got = {r.doc_id: [e["section_id"] for e in json.loads(r.outline)] for r in R.outline_answers(pages_of(spark, docs), Contents()).collect()}
    assert got == {1: ["A", "P2", "P3", "P4", "P5", "P6", "P7"]}
    few = R.outline_answers(pages_of(spark, docs), Contents(), first=2).collect()
    assert [e["section_id"] for e in json.loads(few[0].outline)] == ["A", "P2"]


def test_gaps_repeats_and_nothing(spark):
    rows = [(1, 2, "p2"), (1, 7, "p7"), (1, 7, "p7"), (1, None, "x"), (None, 1, "x"), (2, 7, "p7")]
    pages = spark.createDataFrame(rows, "doc_id bigint, page int, image string")
    first = {"p2": {"extracted_questions": asks("A.2")}, "p7": {"extracted_questions": asks("A.7"), "request_back_read": True, "back_read_pages": [2, 3]}}
    got = {(r.doc_id, r.page): json.loads(r.pending or "{}").get("shown") for r in R.read_pages(pages, Scripted(first)).collect()}
    assert got == {(1, 2): None, (1, 7): ["p2", "p7"], (2, 7): ["p7"]}
    assert R.read_pages(pages.where("false"), Scripted({})).collect() == []


def rounds_of(spark, pages, model):
    """Rows by document and page, and the folders of rounds that reading them left."""
    folders = f"{shared_folder(spark).removeprefix('file:')}/reading-*/rounds/*"
    held = set(glob.glob(folders))
    rows = {(r.doc_id, r.page): r for r in R.read_pages(pages, model).collect()}
    return rows, len(set(glob.glob(folders)) - held)


def test_rounds_do_not_follow_the_pages_of_a_document(spark):
    docs = {1: {n: f"p{n}" for n in range(1, 31)}, 2: {1: "p1"}}
    rows, rounds = rounds_of(spark, pages_of(spark, docs), Looker())
    assert len(rows) == 31 and rounds == 1


@pytest.mark.parametrize("limits", [(2**20, 4), (4, 4), (2**20, 1)])
def test_rounds_of_few_pages_give_the_same_rows(spark, monkeypatch, limits):
    first = {f"p{n}": {"extracted_questions": asks(f"A.{n}"), "pending_context": f"rest {n}", "detected_new_chapters": [{"id": "ABC"[n % 3]}]} for n in range(1, 14)}
    first["p7"] |= {"request_back_read": True, "back_read_pages": [1, 6, 3, 5]}
    first["p8"] |= {"request_back_read": True, "back_read_pages": [2, 7]}
    first["p13"] |= {"request_back_read": True, "back_read_pages": [9, 10, 4]}
    docs = {1: {n: f"p{n}" for n in range(1, 14)}, 2: {n: f"p{n}" for n in (3, 7, 8, 13)}, 3: {1: "p1"}, 4: {7: "p7", 8: None}}
    model = Scripted(first, {p: {"extracted_questions": asks(f"B.{p[1:]}")} for p in ("p7", "p8", "p13")})
    whole, _ = rounds_of(spark, pages_of(spark, docs), model)
    monkeypatch.setattr(R, "ROUND_BYTES", limits[0])
    monkeypatch.setattr(R, "ROUND_PAGES", limits[1])
    cut, rounds = rounds_of(spark, pages_of(spark, docs), model)
    assert rounds > 3 and cut == whole and len(whole) == 20
    assert json.loads(whole[1, 7].pending)["shown"] == ["p1", "p6", "p3", "p5", "p7"] and json.loads(whole[2, 13].pending)["shown"] == ["p13"]


def test_state_survives_a_round_trip():
    state = P.Reader.start(9, json.dumps([{"section_id": "A", "page": 1, "position": "bottom"}]))
    state.enter({"id": "B", "title": "Second", "depiction": "text"}, 4)
    again = P.Reader.load(state.dump())
    assert vars(again) == vars(state)


def test_calls_overlap_in_order():
    threads, most, open_ = threading.Lock(), 0, 0

    def slow(x):
        nonlocal most, open_
        with threads:
            open_ += 1
            most = max(most, open_)
        time.sleep(0.2 if x != 7 else 5)
        with threads:
            open_ -= 1
        if x == 3:
            raise ValueError("three")
        return x * 10

    start = time.monotonic()
    got = list(models.in_order(slow, range(10), window=5, timeout=1.0))
    assert time.monotonic() - start < 2.5 and most == 5
    assert [g for g in got if not isinstance(g, Exception)] == [0, 10, 20, 40, 50, 60, 80, 90]
    assert isinstance(got[3], ValueError) and isinstance(got[7], TimeoutError)


def test_slow_answers_of_a_column_overlap(spark):
    def model(prompts):
        time.sleep(0.4)
        if prompts[0] == "4":
            raise RuntimeError("no")
        return [prompts[0] + "!"]

    start = time.monotonic()
    df = spark.range(10).repartition(1).select("id", models.chat(F.col("id").cast("string"), model).alias("m"))
    rows = df.orderBy("id").collect()
    assert [r.m.answer for r in rows] == [f"{i}!" if i != 4 else None for i in range(10)] and rows[4].m.error == "RuntimeError: no"
    late = spark.range(2).repartition(1).select(models.chat(F.col("id").cast("string"), model, timeout=0.05).alias("m")).collect()
    assert all(r.m.error.startswith("TimeoutError") for r in late)
    assert time.monotonic() - start < 60


def by_page(rows):
    return sorted((r.doc_id, r.page, r.answer, r.pending, r.active, tuple(r.back_read), r.error) for r in rows)


@pytest.fixture
def store(spark):
    held = spark.conf.get(stream.STATE_STORE[0])
    spark.conf.set(*stream.STATE_STORE)
    yield
    spark.conf.set(stream.STATE_STORE[0], held)


def test_stream_reads_like_the_batch(spark, store, tmp_path):
    docs = {d: {p: f"text {d} {p}" for p in range(1, 8)} for d in (1, 2)}
    pages = pages_of(spark, docs).withColumn("total", F.lit(7)).withColumn("outline", F.lit(None).cast("string"))
    into, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    model = Looker()

    def run(part, patience=600_000):
        part.coalesce(1).write.mode("append").json(into)
        stream.start_reading(spark.readStream.schema(pages.schema).json(into), model, out, checkpoint, patience).awaitTermination()
        return spark.read.parquet(out).collect()

    assert {(r.doc_id, r.page) for r in run(pages.where("page IN (2, 3, 5) OR doc_id = 2 AND page = 1"))} == {(2, 1), (2, 2), (2, 3)}
    # a second start goes on from the checkpoint: waiting pages are read once the missing ones have come
    done = run(pages.where("page IN (4, 6, 7) OR doc_id = 1 AND page = 1"))
    assert by_page(done) == by_page(R.read_pages(pages, model).collect())
    late = run(pages.where("doc_id = 1 AND page = 3"))
    assert [r.error for r in late if r.doc_id == 1 and r.page == 3 and r.error] == [stream.LATE] and len(late) == len(done) + 1


def test_stream_passes_over_a_gap_in_time(spark, store, tmp_path):
    pages = pages_of(spark, {1: {1: "a", 3: "c"}, 2: {1: "z"}}).withColumn("total", F.lit(3)).withColumn("outline", F.lit(None).cast("string"))
    into, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in ("doc_id = 1", "doc_id = 2"):
        pages.where(part).coalesce(1).write.mode("append").json(into)
        stream.start_reading(spark.readStream.schema(pages.schema).json(into), Looker(), out, checkpoint, 0).awaitTermination()
    assert {(r.doc_id, r.page) for r in spark.read.parquet(out).collect()} == {(1, 1), (1, 3), (2, 1)}
