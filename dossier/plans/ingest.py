"""Ingest: items or document nodes to chunk records, ready to embed and store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.chunks import macro_chunks, sliding_chunks
from dossier.functions.modeljson import parse_array
from dossier.functions.text import sanitize_for_storage, strip, tokens_bytes4
from dossier.models import ChatModel, Embedder, chat, embed
from dossier.operators.terms import majority
from dossier.operators.unnest import unnest
from dossier.params import DOC_TYPES, ChunkParams
from dossier.sources import readers


def ingest_records(items: DataFrame, params: ChunkParams = ChunkParams(), tokens=tokens_bytes4) -> DataFrame:
    """(item_id, chunk_source, chunk_idx, chunk_text, embed_text, n_tokens) from titles and replies.

    Each side is chunked on its own and counts from 0; narrow from end to end.
    """
    sides = F.array(
        F.struct(F.lit("question").alias("chunk_source"), F.col("title").alias("t")),
        F.struct(F.lit("answer").alias("chunk_source"), F.col("reply").alias("t")),
    )
    rows = items.select("item_id", F.inline(sides))
    rows = unnest(rows, ["item_id", "chunk_source"], sliding_chunks(F.col("t"), params), "c", "chunk_idx")
    rows = rows.withColumn("chunk_text", sanitize_for_storage(F.col("c"))).drop("c")
    return rows.withColumns({"embed_text": placeholder(F.col("chunk_text")), "n_tokens": tokens(F.col("chunk_text"))})


def placeholder(text: Column) -> Column:
    """What is embedded in place of an empty chunk."""
    return F.when(text == "", "empty").otherwise(text)


def with_header(path: Column, chunk: Column, limit: int | None = None) -> Column:
    """Chunk with its heading path in front, unless the path is in the chunk already; a path beyond ``limit`` is shortened."""
    return headed(sanitize_for_storage(path), chunk, limit)


def headed(path: Column, chunk: Column, limit: int | None = None) -> Column:
    """:func:`with_header` for a path that is clean already, as it is for all chunks of a text once it was cleaned with that text."""
    text = sanitize_for_storage(chunk)
    if limit is not None:
        path = F.when(F.length(path) > limit, F.concat(F.left(path, F.lit(limit)), F.lit("..."))).otherwise(path)
    return F.when((path != "") & ~F.contains(text, path), F.concat(F.lit("["), path, F.lit("]\n"), text)).otherwise(text)


def ingest_questionnaires(items: DataFrame, model: Embedder, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Chunk table rows of active items, with vectors."""
    live = readers.active_items(items)
    return embed(ingest_records(live, params), "embed_text", model).drop("embed_text")


def ingest_totals(masters: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """(master_id, status, items_processed, total_chunks) for every requested questionnaire."""
    live = readers.active_items(items)
    n_items = live.groupBy("master_id").agg(F.count("*").alias("items_processed"))
    # chunks are counted per item before they meet the item table: a hot item stays one row
    per_item = records.groupBy("item_id").agg(F.count("*").alias("n"))
    n_chunks = live.select("item_id", "master_id").join(per_item, "item_id").groupBy("master_id").agg(F.sum("n").alias("total_chunks"))
    out = masters.select("master_id").distinct().join(n_items, "master_id", "left").join(n_chunks, "master_id", "left")
    return out.select(
        "master_id", F.when(F.col("items_processed").isNull(), "no_items").otherwise("success").alias("status"),
        F.coalesce("items_processed", F.lit(0)).alias("items_processed"), F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
    )


def extract_nodes(documents: DataFrame, model: ChatModel) -> DataFrame:
    """(doc_id, sort, doc_type, header_path, content): model nodes of every macro chunk, checked."""
    pieces = unnest(documents, ["doc_id"], macro_chunks(F.col("text")), "c", "piece")
    asked = pieces.withColumn("m", chat(F.col("c"), model))
    rows = unnest(asked, ["doc_id", "piece"], parse_array(F.col("m.answer")), "r", "n")
    get = lambda k: F.coalesce(F.try_element_at("r", F.lit(k)), F.lit(""))
    nodes = rows.select(
        "doc_id", (F.col("piece").cast("bigint") * 2**20 + F.col("n")).alias("sort"), get("doc_type").alias("doc_type"),
        get("header_path").alias("header_path"), get("content").alias("content"),
    )
    return nodes.where(F.col("doc_type").isin(*DOC_TYPES) & (F.col("header_path") != "") & (F.col("content") != ""))


def knowledge_tables(documents: DataFrame, nodes: DataFrame, params: ChunkParams = ChunkParams()) -> dict[str, DataFrame]:
    """The three levels of the document store: master, node, chunk.

    Keys derive from the document and the node position, so a rerun writes the same rows.
    documents: doc_id, doc_name, file_path.
    """
    node_key = lambda: F.left(F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("sort").cast("string")), 256), F.lit(32))
    kind = majority(nodes, "doc_id", "doc_type", "sort")
    master = documents.join(kind, "doc_id").select(
        "doc_id", sanitize_for_storage(F.col("doc_name")).alias("doc_name"), "doc_type", sanitize_for_storage(F.col("file_path")).alias("file_path")
    )
    node = nodes.select(
        node_key().alias("node_id"), "doc_id", sanitize_for_storage(F.col("header_path")).alias("header_path"),
        sanitize_for_storage(F.col("content")).alias("content"), "sort",
    )
    cut = unnest(nodes, [node_key().alias("node_id"), "header_path"], sliding_chunks(F.col("content"), params), "c", "chunk_idx")
    chunk = cut.select("node_id", "chunk_idx", with_header(F.col("header_path"), F.col("c")).alias("chunk_text"))
    chunk = chunk.withColumns({"embed_text": placeholder(F.col("chunk_text")), "n_tokens": tokens_bytes4(F.col("chunk_text"))})
    return {"master": master, "node": node, "chunk": chunk}


def usable_markdown(primary: Column, fallback: Column, minimum: int = 50) -> Column:
    """Converted text, or the fallback reader's text when the first one is too short."""
    return F.when(F.length(strip(F.coalesce(primary, F.lit("")))) < minimum, fallback).otherwise(primary)
