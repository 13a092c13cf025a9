"""Whole pipelines with deterministic stand-in models."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import functions as F

from dossier import models
from dossier.catalog import matching, query
from dossier.catalog.items import _markdown
from dossier.functions import chunks as C
from dossier.operators import match as M
from dossier.operators.unnest import unnest, unnest_structs
from dossier.params import RetrievalParams
from dossier.plans import ask as A
from dossier.plans import breakdown as B
from dossier.plans import ingest as G
from dossier.plans import mining as P
from dossier.plans import reading as R
from dossier.session import settled


class FirstWords:
    """Stand-in term miner: pairs the first words of both sides."""

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            sides = [s.split("\n", 2)[1].split()[:3] for s in p.split("<")[1:] if "\n" in s and not s.startswith("/")]
            a, b = (sides + [[], []])[:2]
            out.append(json.dumps([{"chinese_term": x, "english_term": y, "responsible_unit": ""} for x, y in zip(a, b)], ensure_ascii=False))
        return out


class HeadingOutline:
    """Stand-in outline model: every candidate line is a node."""

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            lines = [ln.split("] ", 1)[1] for ln in p.splitlines() if ln.startswith("- [pos:") and "] " in ln]
            out.append(json.dumps([{"canonical_id": f"N{i}", "heading_title": "", "raw_marker": ln} for i, ln in enumerate(lines, 1)], ensure_ascii=False))
        return out


class TwoTypes:
    """Stand-in node extractor: one node per piece, typed by its length."""

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        kinds = ("REGULATION", "QA")
        return [json.dumps([{"doc_type": kinds[len(p) % 2], "header_path": p[:20], "content": p}], ensure_ascii=False) for p in prompts]


class PageAnswer:
    """Stand-in sequential reader: the first word is a chapter, the lines are questions."""

    def __call__(self, prompts: Sequence[str], images: Sequence[Sequence]) -> list[str]:
        out = []
        for pages in images:
            lines = [ln for ln in pages[-1].split("\n") if ln.strip()]
            code = chr(65 + len(pages[-1]) % 5)
            found = [{"question_id": f"{code}.{i}", "question_text": f"Please describe {ln}"} for i, ln in enumerate(lines, 1)]
            out.append(json.dumps({"extracted_questions": found, "detected_new_chapters": [{"id": code, "title": "", "first_question_id": f"{code}.1"}]}, ensure_ascii=False))
        return out


def _hashed(df, *keys):
    return df.select(*keys, "question_id", F.md5("question_text").alias("text_md5"))


@query("breakdown_v1")
def breakdown_v1(t):
    return _hashed(B.breakdown_v1(_markdown(t), models.EchoItems())["items"], "doc_id", "ord")


@query("breakdown_v2")
def breakdown_v2(t):
    return _hashed(B.breakdown_v2(_markdown(t), models.EchoItems(), HeadingOutline(), models.KeepItems())["items"], "doc_id", "ord")


def _turn_pages(t):
    return t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.col("text").alias("image"))


@query("breakdown_pages")
def breakdown_pages(t):
    labelled = _turn_pages(t).withColumn("image", F.regexp_replace("image", r"(?m)^", "1.1 "))
    return _hashed(B.breakdown_pages(labelled, models.ReadPage(), None, models.KeepItems())["items"], "doc_id", "ord")


@query("breakdown_reading")
def breakdown_reading(t):
    out = R.breakdown_reading(_turn_pages(t), PageAnswer(), None, models.KeepItems())
    return _hashed(unnest_structs(out, ["doc_id", "place", "section"], "questions", ["question_id", "question_text"], "k"), "doc_id", "place", "section", "k")


class Looker:
    """Stand-in reader with a script: every third page asks to see the first page and the one in front again; an answer is the digest of what was shown."""

    def __call__(self, prompts: Sequence[str], images: Sequence[Sequence]) -> list[str]:
        out = []
        for prompt, shown in zip(prompts, images):
            said = {"extracted_questions": [{"question_id": "S.1", "question_text": hashlib.md5("\n".join(shown).encode()).hexdigest()}]}
            at = re.match(r"Page (\d+)/", prompt)
            if at and int(at[1]) % 3 == 0:
                said |= {"request_back_read": True, "back_read_pages": [1, str(int(at[1]) - 1)]}
            out.append(json.dumps(said))
        return out


@query(
    "reading_rounds",
    """WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations),
    looks AS (SELECT doc_id, page, page AS seen, 3 AS place FROM p UNION ALL SELECT doc_id, page, 1, 1 FROM p WHERE page % 3 = 0 UNION ALL SELECT doc_id, page, page - 1, 2 FROM p WHERE page % 3 = 0)
    SELECT l.doc_id, l.page::INT AS page, (l.page % 3 = 0) AS looked_back, md5(string_agg(s.text, chr(10) ORDER BY place)) AS shown_md5
    FROM looks l JOIN p s ON s.doc_id = l.doc_id AND s.page = l.seen GROUP BY ALL""",
)
def reading_rounds(t):
    """Every turn as a page: which pages the model was shown for it."""
    read = R.read_pages(_turn_pages(t), Looker())
    shown = F.get_json_object("answer", "$[0].question_text")
    return read.select("doc_id", "page", (F.size("back_read") > 0).alias("looked_back"), shown.alias("shown_md5"))


@query("outline_map")
def outline_map(t):
    """Page map of an outline made of the first words of every turn."""
    word = lambda n: F.element_at(F.split("text", " "), n)
    entries = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("bigint").alias("ord"), F.concat(F.char((F.col("turn") % 26 + 65).cast("long")), F.lit(": "), word(1)).alias("section_id"),
        F.lit("").alias("subsection_id"), F.lit("").alias("title"), (F.col("turn") + 1).cast("string").alias("page"), F.lit("top").alias("position"), F.lit(True).alias("is_major"), F.col("text").alias("depiction"),
    )
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"))
    return R.outline_map(entries, pages)["pages"].select("doc_id", "page", "section_id", "position", F.col("is_major").cast("int").alias("is_major"), F.md5("depiction").alias("depiction_md5"))


@query("term_mining")
def term_mining(t):
    docs = t.documents.select("doc_id", F.col("text").alias("zh_text"), F.col("text").alias("en_text"))
    out = P.mine_documents(docs, FirstWords())
    return out.select("zh", "en", "count", F.size("sources").alias("n_sources"))


@query("knowledge_ingest")
def knowledge_ingest(t):
    docs = t.documents.select("doc_id", "text", F.col("source").alias("doc_name"), F.col("source").alias("file_path"))
    tables = G.knowledge_tables(docs, G.extract_nodes(docs, TwoTypes()))
    return tables["chunk"].select("node_id", "chunk_idx", F.md5("chunk_text").alias("text_md5"), "n_tokens")


@query(
    "ingest_totals",
    """WITH i AS (SELECT o_orderkey AS item_id, o_custkey AS master_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS d FROM orders),
    l AS (SELECT * FROM i WHERE d IS NULL OR d = 0), n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT c_custkey AS master_id, CASE WHEN count(item_id) = 0 THEN 'no_items' ELSE 'success' END AS status, count(item_id) AS items_processed, coalesce(sum(n), 0) AS total_chunks
    FROM customer LEFT JOIN l ON l.master_id = c_custkey LEFT JOIN n ON n.l_orderkey = l.item_id GROUP BY 1""",
)
def ingest_totals(t):
    items = t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("master_id"),
                            F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("int")).otherwise((F.col("o_orderkey") % 4 == 0).cast("int")).alias("is_deleted"))
    return G.ingest_totals(t.customer.select(F.col("c_custkey").alias("master_id")), items, t.lineitem.select(F.col("l_orderkey").alias("item_id")))


@query("ask_pipeline")
def ask_pipeline(t):
    """Every user turn asked against the chunks of all documents."""
    pieces = unnest(t.documents, ["doc_id"], C.sliding_chunks(F.col("text")), "chunk_text", "chunk_idx")
    chunks = models.embed(pieces, "chunk_text", models.HashingEmbedder(64)).select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")).alias("chunk_pk"), F.col("doc_id").alias("parent_id"),
        F.lit("answer").alias("chunk_source"), "chunk_idx", "chunk_text", "embedding",
    )
    # the search reads the vectors once for each block of queries, so they are made once, as the table that a service keeps
    chunks = settled(chunks)
    items = t.documents.select(F.col("doc_id").alias("parent_id"), F.lit(0).alias("is_deleted"), F.col("source").alias("master_id"),
                               F.concat_ws(" ", "lang", F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("reply"), F.col("doc_id").cast("string").alias("item_no"))
    masters = t.documents.groupBy(F.col("source").alias("master_id")).agg(F.max("lang").alias("master_name"))
    files = masters.select("master_id", F.col("master_id").alias("file_path"), F.lit(0).alias("is_deleted"))
    asked = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    patterns = M.dictionary_patterns(matching._dictionary(t), matching._stems(t))
    out = A.ask(asked, A.Corpus(chunks, items, masters, files), patterns, M.intent_patterns(matching._units(t)), models.HashingEmbedder(64), models.EchoAnswer(),
                params=RetrievalParams(top_n=3, threshold=1.0))
    return out["answers"].select("query_id", F.md5("prompt").alias("prompt_md5"), F.md5("english").alias("english_md5"), F.md5("chinese_answer").alias("chinese_md5"))
