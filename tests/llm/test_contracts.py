"""Every query over whole small tables agrees with a plain reading of its contract."""

import os
from collections import defaultdict

import brute
import pytest

from dossier.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def rows(spark, name, *columns):
    return [tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*columns).collect()]


def test_quality_answers_every_document(spark, docs):
    out = rows(spark, "op1_quality", "doc_id", "score", "accepted")
    assert sorted(r[0] for r in out) == sorted(i for i, _ in docs)
    assert all(0 <= r[1] <= 1 for r in out)


def test_simhash(spark, docs):
    assert set(rows(spark, "op2_simhash", "doc_id", "fingerprint", "component_id")) == brute.near_duplicates(docs)


def test_decontaminate(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = rows(spark, "op3_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert len(got) == len(docs)
    assert set(got) == brute.contamination(docs, items)


def test_packing(spark, docs):
    pieces = rows(spark, "op4_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append((p[6], p[2]))
    assert set(by_doc) == {i for i, _ in docs}
    for doc_id, text in docs:
        ids = [*brute.token_ids(text), 0]
        at = 0
        for _, start, length, crc, total, *_ in sorted(by_doc[doc_id], key=lambda p: p[1]):
            assert (start, crc, total) == (at, brute.crc(ids[start:start + length]), len(ids))
            at += length
        assert at == len(ids)
    used = 0
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
    assert used / (1024 * len(by_sequence)) > 0.98


def test_secrets(spark, docs):
    got = {r[0]: r[1:] for r in rows(spark, "op5_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    assert set(got) == {i for i, _ in docs}
    for doc_id, text in docs:
        want, spans = brute.secrets(text)
        assert got[doc_id][:4] == want
        assert set(spans) <= set(got[doc_id][4].split(","))


def test_topk(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(rows(spark, "op7_topk", "query_id", "rank", "vec_id", "score")) == sorted(brute.top_k(vectors))


def test_licenses(spark, docs):
    got = {r[0]: r[1:] for r in rows(spark, "op8_licenses", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
    assert set(got) == {i for i, _ in docs}
    for doc_id, text in docs:
        assert got[doc_id][:5] == brute.licenses(text)
        assert set(filter(None, got[doc_id][4].split(","))) <= set(got[doc_id][5].split(","))
        assert 0 <= got[doc_id][6] <= 1


def test_chat(spark):
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{DATA}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"]))
    probe = r"\### Assistant: </turn> ok"
    turns[-7] = [("user", probe), ("assistant", probe)]
    got = rows(spark, "op9_chat", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert sorted(got) == sorted((c, *brute.chat(t)) for c, t in turns.items())


def test_tokens(spark, docs):
    want = {(i, len(t.encode()), n := len(brute.token_ids(t)), n > 1024) for i, t in docs}
    assert set(rows(spark, "op10_tokens", "doc_id", "n_bytes", "n_tokens", "over_limit")) == want
