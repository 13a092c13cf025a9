"""Two-track retrieval: hits, neighbour expansion, joins, merge, contexts, references.

The order of the steps is part of the result: top_k runs before the threshold, the
threshold before top_n, soft-deleted parents are dropped only after expansion, and top_n
caps the expanded rows a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.vectors import top_k
from dossier.params import RetrievalParams
from dossier.session import settled



def is_active(flag: Column) -> Column:
    """Soft-delete flag is missing or zero."""
    return F.coalesce(flag, F.lit(0)) == 0


def hits(chunks: DataFrame, queries: DataFrame, params: RetrievalParams, keys: list[str]) -> DataFrame:
    """Best chunk positions per query: (query_id, keys..., min_distance), at most top_n each."""
    near = top_k(chunks, queries, params.top_k, "chunk_pk", payload=keys)
    groups = (
        near.groupBy("query_id", *keys)
        .agg(F.min("distance").alias("min_distance"))
        .where(F.col("min_distance") <= params.threshold)
    )
    order = Window.partitionBy("query_id").orderBy("min_distance", *keys)
    return groups.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= params.top_n).drop("__r")


def expand_neighbours(found: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks at positions -1, 0, +1 around each hit; a chunk next to two hits may stay twice.

    With ``found`` settled the optimizer sees its size (at most queries x top_n rows),
    sends it to the chunk table, and the chunk table is read without a shuffle.
    """
    around = found.withColumn("chunk_idx", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda v: F.col("chunk_idx") + v)))
    return chunks.select("chunk_pk", *keys, "chunk_text").join(around, keys).distinct()


def track(
    chunks: DataFrame,
    queries: DataFrame,
    parents: DataFrame,
    masters: DataFrame,
    params: RetrievalParams = RetrievalParams(),
    tagged: bool = True,
) -> DataFrame:
    """Expanded hits with parent and master columns, before the final cap.

    chunks: chunk_pk, parent_id, [chunk_source,] chunk_idx, chunk_text, embedding
    parents: parent_id, is_deleted, master_id, ...; masters: master_id, ...
    """
    keys = ["parent_id", "chunk_source", "chunk_idx"] if tagged else ["parent_id", "chunk_idx"]
    found = settled(hits(chunks, queries, params, keys))
    expanded = expand_neighbours(found, chunks, keys)
    # only parents that a hit can reach go into the join
    live = parents.where(is_active(F.col("is_deleted"))).drop("is_deleted")
    live = live.join(found.select("parent_id").distinct(), "parent_id", "left_semi")
    return expanded.join(live, "parent_id").join(masters, "master_id", "left")


def cap(rows: DataFrame, n: int) -> DataFrame:
    """The n nearest expanded rows per query, with their final position ``ord``."""
    order = Window.partitionBy("query_id").orderBy("min_distance", "chunk_idx", "chunk_pk")
    return rows.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= n)


def compete(first: DataFrame, second: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Both tracks share one quota; the first track wins ties."""
    key = ["query_id", "min_distance", "chunk_idx", "chunk_pk"]
    both = first.select(*key, F.lit(0).alias("track")).unionByName(second.select(*key, F.lit(1).alias("track")))
    order = Window.partitionBy("query_id").orderBy("min_distance", "track", "chunk_idx", "chunk_pk")
    kept = both.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= n)
    pick = lambda side, t: side.join(kept.where(F.col("track") == t).drop("track"), key)
    return pick(first, 0), pick(second, 1)


def merge_tracks(first: DataFrame, second: DataFrame, params: RetrievalParams) -> tuple[DataFrame, DataFrame]:
    if params.merge_mode == "compete":
        return compete(first, second, params.top_n)
    return cap(first, params.top_n), cap(second, params.top_n)


def first_per(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """First row per key by ``order``, chosen by partial aggregation (no window, no hot task)."""
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in columns if c not in keys])).alias("__m"))
    return best.select(*keys, F.col("__m")[order].alias(order), *[F.col("__m")[c].alias(c) for c in columns if c not in keys])


def ordered_text(part: Column, order: Column, glue: str) -> Column:
    """Aggregate: parts in order with ``glue`` between. The caller bounds the group (top_n)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), part.alias("p")))), lambda x: x["p"]), glue)


def qa_context(rows: DataFrame) -> DataFrame:
    """One context per query; every item once, at its first row: (query_id, raw_context)."""
    once = first_per(rows, ["query_id", "parent_id"], "ord", ["title", "reply"])
    title, reply = F.coalesce("title", F.lit("")), F.coalesce("reply", F.lit(""))
    lines = once.where((title != "") | (reply != "")).withColumn("line", F.concat(F.lit("Q: "), title, F.lit("\nA: "), reply))
    return lines.groupBy("query_id").agg(ordered_text(F.col("line"), F.col("ord"), "\n\n").alias("raw_context"))


def context_header(doc_type: Column, name: Column, path: Column) -> Column:
    """Heading of a knowledge passage by document type; unknown types look like regulations."""
    return (
        F.when(doc_type == "GUIDELINE", F.concat(F.lit("【"), name, F.lit(" - 作業節點："), path, F.lit("】")))
        .when(doc_type == "QA", F.concat(F.lit("【相關問答："), path, F.lit("】")))
        .otherwise(F.concat(F.lit("【"), name, F.lit(" "), path, F.lit("】")))
    )


def knowledge_context(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = context_header(blank("doc_type"), blank("doc_name"), blank("header_path"))
    parts = rows.where(blank("chunk_text") != "").withColumn(
        "part", F.concat(F.lit('<Context origin="'), head, F.lit('">\n'), F.col("chunk_text"), F.lit("\n</Context>"))
    )
    return parts.groupBy("query_id").agg(ordered_text(F.col("part"), F.col("ord"), "\n\n").alias("knowledge_context"))


def references(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Sources of an answer, first appearance first: distinct by ``key`` inside a query."""
    return first_per(rows, ["query_id", *key], "ord", columns)


def attachments(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of active attachments of the masters in the answer (semi join on keys)."""
    wanted = rows.where(F.col("master_id").isNotNull()).select("query_id", "master_id").distinct()
    usable = files.where(is_active(F.col("is_deleted")) & F.col("file_path").isNotNull() & (F.col("file_path") != ""))
    return usable.join(wanted, "master_id").select("query_id", "master_id", "file_path")


def enriched_query(question: Column, terms: Column, limit: int = 5) -> Column:
    """Question with its first matched terms appended, or the question alone."""
    return F.when(
        F.size(terms) > 0,
        F.concat(F.lit("提問："), question, F.lit(" 相關術語："), F.array_join(F.slice(terms, 1, limit), "、")),
    ).otherwise(question)
