"""Registered queries of this package: every operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import audit, chat, decontaminate, licenses, packing, quality, secrets, simhash, tokens, topk, toxicity, warc, whitening
from dossier.llm.shared import shared_path

TOKENIZER = "byte_bpe_50k.json"
ARCHIVE_DATE = "2024-01-01T00:00:00Z"
#: Queries of the search are rows whose id is divisible by this.
ASKED_EVERY = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL for queries that it can express on whole tables; the others are held against brute force in tests.
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), shared_path(spark, "blob-ledger")).drop("digest")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages"), ARCHIVE_DATE))


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % ASKED_EVERY == 0))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat.digests(chat.format_chats(turns))


@query
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), shared_path(spark, "count-cache"))


@query
def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLE["op11_filters"] = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
), words AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), failing AS (
    SELECT doc_id, part,
        (len(w) < 100)::INT AS a,
        (100 * len(list_distinct(w)) < 80 * len(w))::INT AS b,
        (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT AS c,
        regexp_matches(text, '[#$%&*|]')::INT AS d,
        coalesce(doc_id > first, false)::INT AS e
    FROM words
), marked AS (
    SELECT f.part, [a, b, c, d, e] AS fails, a + b + c + d + e AS n_fails, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad
    FROM failing f LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id) l ON f.doc_id = l.doc_id
), kinds AS (
    SELECT part, fails, n_fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM marked GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 3, 4, 5]) AS place
), orders AS (
    SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.place, w.place, x.place, y.place, z.place] AS places
    FROM letters v JOIN letters w ON w.place <> v.place JOIN letters x ON x.place NOT IN (v.place, w.place)
        JOIN letters y ON y.place NOT IN (v.place, w.place, x.place) JOIN letters z ON z.place NOT IN (v.place, w.place, x.place, y.place)
), steps AS (
    SELECT filter_order, step, places[step] AS place, places[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), seen AS (
    SELECT s.filter_order, s.step, s.place, k.part, k.n, k.good, k.bad, k.n_fails, k.fails[s.place] = 1 AS fail,
        len(list_filter(s.before, lambda i: k.fails[i] = 1)) > 0 AS gone
    FROM steps s, kinds k
), cells AS (
    SELECT part, filter_order, step, place,
        sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fail AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN NOT gone AND fail THEN bad ELSE 0 END)::BIGINT AS toxic_lost
    FROM seen GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, place))::BIGINT AS shapley
FROM cells
"""

ORACLE["op7_topk"] = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {ASKED_EVERY} = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
