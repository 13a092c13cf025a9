"""Retrieval queries over ``embeddings`` read as a chunk table.

item = vec_id div 10, position = vec_id mod 10, source by item parity; items hang on the
25 nations as masters. The query vectors are the first vector of every label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import query
from dossier.operators import retrieval as R
from dossier.operators.vectors import cosine_distance, top_k
from dossier.params import RetrievalParams

PARAMS = RetrievalParams(top_n=5, threshold=0.9)
COMPETE = RetrievalParams(top_n=5, threshold=0.9, merge_mode="compete")


def chunk_table(t, parity=None):
    e = t.embeddings if parity is None else t.embeddings.where(F.col("label") % 2 == parity)
    item = F.floor(F.col("vec_id") / 10)
    return e.select(
        F.col("vec_id").alias("chunk_pk"), item.alias("parent_id"),
        F.when(item % 2 == 0, "question").otherwise("answer").alias("chunk_source"),
        (F.col("vec_id") % 10).alias("chunk_idx"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"),
        "embedding",
    )


def query_table(t):
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vec"), F.min("vec_id").alias("query_id"))
    return first.select("query_id", "query_vec")


def parent_table(t):
    item = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("parent_id")).distinct()
    return item.select(
        "parent_id",
        F.when(F.col("parent_id") % 7 == 0, 1).when(F.col("parent_id") % 3 == 0, F.lit(None).cast("int")).otherwise(0).alias("is_deleted"),
        (F.col("parent_id") % 30).alias("master_id"),
        F.concat(F.lit("title "), F.col("parent_id").cast("string")).alias("title"),
        F.when(F.col("parent_id") % 4 != 0, F.concat(F.lit("reply "), F.col("parent_id").cast("string"))).alias("reply"),
        (F.col("parent_id") % 2).cast("string").alias("item_no"),
    )


def master_table(t):
    return t.nation.select(F.col("n_nationkey").cast("bigint").alias("master_id"), F.col("n_name").alias("master_name"))


def both_tracks(t):
    args = (query_table(t), parent_table(t), master_table(t), PARAMS)
    return R.track(chunk_table(t, 0), *args), R.track(chunk_table(t, 1), *args, tagged=False)


SQL_BASE = """
WITH chunks AS (
  SELECT vec_id AS chunk_pk, vec_id // 10 AS parent_id,
         CASE WHEN (vec_id // 10) % 2 = 0 THEN 'question' ELSE 'answer' END AS chunk_source,
         vec_id % 10 AS chunk_idx, 'chunk ' || vec_id AS chunk_text, label, embedding::DOUBLE[] AS v
  FROM embeddings),
q AS (SELECT chunk_pk AS query_id, v AS qv FROM chunks WHERE chunk_pk IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
parents AS (
  SELECT DISTINCT parent_id, CASE WHEN parent_id % 7 = 0 THEN 1 WHEN parent_id % 3 = 0 THEN NULL ELSE 0 END AS is_deleted,
         parent_id % 30 AS master_id, 'title ' || parent_id AS title,
         CASE WHEN parent_id % 4 <> 0 THEN 'reply ' || parent_id END AS reply, CAST(parent_id % 2 AS VARCHAR) AS item_no
  FROM chunks),
masters AS (SELECT n_nationkey AS master_id, n_name AS master_name FROM nation)
"""


def sql_track(name: str, where: str, tagged: bool) -> str:
    src = "chunk_source, " if tagged else ""
    on_src = "c.chunk_source = e.chunk_source AND " if tagged else ""
    return f""",
{name}_near AS (
  SELECT query_id, chunk_pk, parent_id, chunk_source, chunk_idx, d,
         row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_pk) AS rk
  FROM (SELECT q.query_id, c.*, round(list_cosine_distance(c.v, q.qv), 9) AS d FROM chunks c, q WHERE {where})),
{name}_agg AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY min_distance, parent_id, {src}chunk_idx) AS r
    FROM (SELECT query_id, parent_id, {src}chunk_idx, min(d) AS min_distance FROM {name}_near WHERE rk <= 30
          GROUP BY query_id, parent_id, {src}chunk_idx HAVING min(d) <= 0.9)) WHERE r <= 5),
{name}_adj AS (SELECT unnest([-1, 0, 1]) AS v),
{name}_exp AS (SELECT query_id, parent_id, {src}chunk_idx + v AS idx, min_distance FROM {name}_agg, {name}_adj),
{name}_chunks AS (
  SELECT DISTINCT e.query_id, c.chunk_pk, c.parent_id, {"c.chunk_source, " if tagged else ""}c.chunk_idx, c.chunk_text, e.min_distance
  FROM {name}_exp e JOIN (SELECT * FROM chunks c WHERE {where}) c ON {on_src}c.parent_id = e.parent_id AND c.chunk_idx = e.idx),
{name} AS (
  SELECT x.*, p.master_id, p.title, p.reply, p.item_no, m.master_name
  FROM {name}_chunks x JOIN parents p ON p.parent_id = x.parent_id AND (p.is_deleted IS NULL OR p.is_deleted = 0)
  LEFT JOIN masters m ON m.master_id = p.master_id),
{name}_cap AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY min_distance, chunk_idx, chunk_pk) AS ord FROM {name})
  WHERE ord <= 5)
"""


TRACK_A = SQL_BASE + sql_track("a", "TRUE", True)
TWO = SQL_BASE + sql_track("a", "c.label % 2 = 0", True) + sql_track("b", "c.label % 2 = 1", False)


@query(
    "knn_topk",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, label, round(list_cosine_distance(embedding::DOUBLE[], v), 6) AS distance
    FROM embeddings, q ORDER BY round(list_cosine_distance(embedding::DOUBLE[], v), 9), vec_id LIMIT 30""",
)
def knn_topk(t):
    q = t.embeddings.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    near = top_k(t.embeddings, q, 30, "vec_id", payload=["label"])
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(
    "knn_multi_query",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings
                WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
    d AS (SELECT query_id, vec_id, round(list_cosine_distance(embedding::DOUBLE[], qv), 9) AS d FROM embeddings, q)
    SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) WHERE rank <= 10""",
)
def knn_multi_query(t):
    near = top_k(t.embeddings, query_table(t), 10, "vec_id")
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "cosine_self_label",
    """WITH q AS (SELECT label, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
    SELECT e.vec_id, round(list_cosine_distance(e.embedding::DOUBLE[], q.c), 6) AS distance FROM embeddings e JOIN q ON q.label = e.label""",
)
def cosine_self_label(t):
    """Distance of every vector to the first one of its label, as a JVM expression."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    d = t.embeddings.join(first, "label")
    return d.select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("c")), 6).alias("distance"))


@query(
    "neighbor_expand",
    TRACK_A + """SELECT query_id, chunk_pk, parent_id, chunk_source, chunk_idx, round(min_distance, 6) AS min_distance FROM a_chunks""",
)
def neighbor_expand(t):
    keys = ["parent_id", "chunk_source", "chunk_idx"]
    chunks = chunk_table(t)
    found = R.hits(chunks, query_table(t), PARAMS, keys)
    rows = R.expand_neighbours(found, chunks, keys)
    return rows.select("query_id", "chunk_pk", *keys, F.round("min_distance", 6).alias("min_distance"))


@query(
    "track_a_retrieve",
    TRACK_A + """SELECT query_id, ord, chunk_pk, parent_id, chunk_source, chunk_idx, chunk_text, title, reply, item_no, master_id,
    master_name, round(min_distance, 6) AS min_distance FROM a_cap""",
)
def track_a_retrieve(t):
    rows = R.cap(R.track(chunk_table(t), query_table(t), parent_table(t), master_table(t), PARAMS), PARAMS.top_n)
    return rows.select(
        "query_id", "ord", "chunk_pk", "parent_id", "chunk_source", "chunk_idx", "chunk_text", "title", "reply", "item_no",
        "master_id", "master_name", F.round("min_distance", 6).alias("min_distance"),
    )


_MERGED = ["query_id", "track", "ord", "chunk_pk", "min_distance"]


def _merged(pair):
    a, b = pair
    pick = lambda d, n: d.select("query_id", F.lit(n).alias("track"), "ord", "chunk_pk", F.round("min_distance", 6).alias("min_distance"))
    return pick(a, 0).unionByName(pick(b, 1))


@query(
    "merge_independent",
    TWO + """SELECT query_id, 0 AS track, ord, chunk_pk, round(min_distance, 6) AS min_distance FROM a_cap
    UNION ALL SELECT query_id, 1, ord, chunk_pk, round(min_distance, 6) FROM b_cap""",
)
def merge_independent(t):
    return _merged(R.merge_tracks(*both_tracks(t), PARAMS))


@query(
    "merge_compete",
    TWO + """SELECT query_id, track, ord, chunk_pk, round(min_distance, 6) AS min_distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY min_distance, track, chunk_idx, chunk_pk) AS ord FROM (
        SELECT query_id, chunk_pk, chunk_idx, min_distance, 0 AS track FROM a
        UNION ALL SELECT query_id, chunk_pk, chunk_idx, min_distance, 1 FROM b)) WHERE ord <= 5""",
)
def merge_compete(t):
    return _merged(R.merge_tracks(*both_tracks(t), COMPETE))


def _answer_rows(t):
    return R.cap(R.track(chunk_table(t), query_table(t), parent_table(t), master_table(t), PARAMS), PARAMS.top_n)


@query(
    "context_concat",
    TRACK_A + """SELECT query_id, string_agg('Q: ' || title || chr(10) || 'A: ' || coalesce(reply, ''), chr(10) || chr(10) ORDER BY ord) AS raw_context
    FROM (SELECT query_id, parent_id, min(ord) AS ord, min(title) AS title, min(reply) AS reply FROM a_cap GROUP BY query_id, parent_id)
    GROUP BY query_id""",
)
def context_concat(t):
    return R.qa_context(_answer_rows(t))


@query(
    "references_dedup",
    TRACK_A + """SELECT query_id, master_id, item_no, master_name, ord FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, master_id, item_no ORDER BY ord) AS k FROM a_cap) WHERE k = 1""",
)
def references_dedup(t):
    return R.references(_answer_rows(t), ["master_id", "item_no"], ["master_name"])


@query(
    "attachment_semi",
    TRACK_A + """SELECT DISTINCT x.query_id, x.master_id, s.s_name AS file_path FROM a_cap x JOIN supplier s ON s.s_nationkey = x.master_id
    WHERE s.s_suppkey % 5 <> 0 AND s.s_suppkey % 3 <> 0""",
)
def attachment_semi(t):
    files = t.supplier.select(
        F.col("s_nationkey").cast("bigint").alias("master_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("file_path"),
        F.when(F.col("s_suppkey") % 5 == 0, 1).alias("is_deleted"),
    )
    return R.attachments(_answer_rows(t).withColumn("master_id", F.col("master_id")), files)


@query(
    "knowledge_context",
    SQL_BASE + sql_track("b", "TRUE", False) + """,
    typed AS (SELECT *, CASE parent_id % 4 WHEN 0 THEN 'REGULATION' WHEN 1 THEN 'GUIDELINE' WHEN 2 THEN 'QA' ELSE 'OTHER' END AS doc_type FROM b_cap)
    SELECT query_id, string_agg('<Context origin="' || CASE doc_type
        WHEN 'GUIDELINE' THEN '【' || coalesce(master_name, '') || ' - 作業節點：' || title || '】'
        WHEN 'QA' THEN '【相關問答：' || title || '】'
        ELSE '【' || coalesce(master_name, '') || ' ' || title || '】' END || '">' || chr(10) || chunk_text || chr(10) || '</Context>',
        chr(10) || chr(10) ORDER BY ord) AS knowledge_context FROM typed GROUP BY query_id""",
)
def knowledge_context(t):
    rows = R.cap(R.track(chunk_table(t), query_table(t), parent_table(t), master_table(t), PARAMS, tagged=False), PARAMS.top_n)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("REGULATION", "GUIDELINE", "QA", "OTHER")]), (F.col("parent_id") % 4 + 1).cast("int"))
    return R.knowledge_context(
        rows.withColumns({"doc_type": kind, "doc_name": F.col("master_name"), "header_path": F.col("title")})
    )
