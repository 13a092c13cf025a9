"""Bilingual term mining: paired documents or question pairs to ranked, grounded terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.modeljson import parse_array, parse_term_pairs
from dossier.functions.text import strip
from dossier.models import ChatModel, chat
from dossier.operators import terms as M
from dossier.operators.unnest import unnest, unnest_structs
from dossier.session import checkpoint


def paired_chunks(documents: DataFrame, with_blocks: bool = False) -> DataFrame:
    """(doc_id, i, a, b): aligned chunks of both sides, one document per row, no shuffle.

    documents: doc_id, zh_text, en_text[, zh_blocks, en_blocks]. Structure chunks are used
    where both sides have at least five layout blocks.
    """
    if with_blocks:
        enough = (F.size("zh_blocks") >= M.MIN_BLOCKS) & (F.size("en_blocks") >= M.MIN_BLOCKS)
        sides = [M.mining_chunks(F.col(f"{s}_text"), F.col(f"{s}_blocks"), enough).alias(s) for s in ("zh", "en")]
    else:
        sides = [M.mining_chunks(F.col(f"{s}_text"), None).alias(s) for s in ("zh", "en")]
    cut = documents.select("doc_id", *sides)
    return unnest_structs(cut.withColumn("p", M.align(F.col("zh"), F.col("en"))), ["doc_id"], "p", ["i", "a", "b"])


def mine_documents(documents: DataFrame, model: ChatModel, with_blocks: bool = False) -> DataFrame:
    """Ranked terms of document pairs; pairs the texts do not hold are dropped."""
    chunks = paired_chunks(documents, with_blocks)
    prompt = F.concat(F.lit("<Chinese>\n"), F.col("a"), F.lit("\n</Chinese>\n<English>\n"), F.col("b"), F.lit("\n</English>"))
    asked = chunks.withColumn("m", chat(prompt, model))
    rows = unnest_structs(asked, ["doc_id", "i"], parse_term_pairs(F.col("m.answer")), ["zh", "en", "unit"], "k")
    # used on both sides of the grounding join, and made of model calls
    rows = checkpoint(rows)
    good = M.grounded_pairs(rows, documents, "doc_id")
    return M.ranked_terms(good.withColumns({"source": F.col("doc_id").cast("string"), "ord": F.struct("doc_id", "i", "k")}))


def mine_questions(items: DataFrame, model: ChatModel) -> DataFrame:
    """Ranked terms of question and answer texts (no grounding); items: item_id, title, reply, source_name."""
    prompt = F.concat(F.lit("<Question>\n"), F.coalesce("title", F.lit("")), F.lit("\n</Question>\n<Answer>\n"), F.coalesce("reply", F.lit("")), F.lit("\n</Answer>"))
    asked = items.withColumn("m", chat(prompt, model))
    rows = unnest_structs(asked, ["item_id", F.col("source_name").alias("source")], parse_term_pairs(F.col("m.answer")), ["zh", "en", "unit"], "k")
    return M.ranked_terms(rows.withColumn("ord", F.struct("item_id", "k")))


def mine_stems(terms: DataFrame, model: ChatModel, batch: int = 50) -> DataFrame:
    """Stem to official term: the suffix rule, then the model for the rest in batches."""
    left = M.batches(M.needs_model(terms), "ord", batch)
    # at most ``batch`` rows per group by construction
    groups = left.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("xs"))
    asked = groups.withColumn("m", chat(F.to_json(F.transform("xs", lambda x: x["term"])), model))
    said = unnest(asked, ["xs"], parse_array(F.coalesce("m.answer", F.lit(""))), "r", "k")
    get = lambda k: strip(F.coalesce(F.try_element_at("r", F.lit(k)), F.lit("")))
    answers = said.select(get("original").alias("original"), get("stem").alias("stem"), (F.element_at("xs", 1)["ord"].cast("decimal(38,0)") * 2**31 + F.col("k")).alias("ord"))
    return M.stem_mapping(terms, answers)


def mine_aliases(units: DataFrame, model: ChatModel, batch: int = 10) -> DataFrame:
    """(keyword, alias, ord): model aliases of every unit keyword, matched by position."""
    known = checkpoint(M.first_keywords(units).withColumn("ord", F.xxhash64("keyword")))
    left = M.batches(known, "ord", batch)
    groups = left.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", "keyword", "agency", "unit"))).alias("xs"))
    asked = groups.withColumn("m", chat(F.to_json("xs"), model))
    lists = F.transform(
        parse_array(F.coalesce("m.answer", F.lit(""))),
        lambda r: F.coalesce(F.from_json(F.try_element_at(r, F.lit("aliases")), "array<string>"), F.array().cast("array<string>")),
    )
    zipped = M.positional_answers(F.transform("xs", lambda x: x["keyword"]), lists)
    rows = unnest(unnest_structs(asked, [], zipped, ["keyword", "aliases"]), ["keyword"], "aliases", "alias", "k")
    return M.valid_aliases(rows.withColumn("ord", F.col("k")), known)


def expand_keywords(units: DataFrame, model: ChatModel) -> DataFrame:
    """(agency, unit, keywords, extended): model keywords of every unit row that gave a list."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    prompt = F.concat_ws(" | ", blank("agency"), blank("unit"), blank("keywords"))
    said = units.withColumn("m", chat(prompt, model))
    listed = F.from_json(F.regexp_extract(F.coalesce("m.answer", F.lit("")), r"(?s)\[.*?\]", 0), "array<string>")
    return said.select("agency", "unit", "keywords", F.coalesce(listed, F.array().cast("array<string>")).alias("extended")).where(F.size("extended") > 0)
