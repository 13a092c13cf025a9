"""Bilingual term mining: alignment, validation, aggregation, stems and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.chunks import sliding_chunks, structure_chunks
from dossier.functions.text import (
    STEM_STOPWORDS, clean_markdown, let, split_keywords, split_units, strip, trim_suffix, valid_alias_shape, valid_stem,
)
from dossier.operators.ordered import row_index
from dossier.operators.unnest import unnest
from dossier.params import MINING_CHUNK_OVERLAP, MINING_CHUNK_SIZE, ChunkParams

MAX_AMBIGUITY = 5
MIN_BLOCKS = 5


def align(left: Column, right: Column) -> Column:
    """``array<struct<i,a,b>>``: two lists matched by relative position; empty when a side is empty."""

    def paired(s: Column) -> Column:
        l, r = s["l"], s["r"]
        n = F.greatest(F.size(l), F.size(r))
        at = lambda arr, i: F.element_at(arr, F.floor(i * F.size(arr) / n).cast("int") + 1)
        pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), at(l, i).alias("a"), at(r, i).alias("b")))
        return F.when((F.size(l) > 0) & (F.size(r) > 0), pairs)

    # both lists are usually computed, and every pair looks into them
    return let(F.struct(left.alias("l"), right.alias("r")), paired)


def mining_chunks(text: Column, blocks: Column | None, use_blocks: Column | None = None) -> Column:
    """Chunk texts of one side: by structure when both sides have enough blocks, else sliding."""
    sliding = sliding_chunks(text, ChunkParams(MINING_CHUNK_SIZE, MINING_CHUNK_OVERLAP), keep_blank=False)
    if blocks is None:
        return sliding
    return F.when(use_blocks, structure_chunks(blocks)).otherwise(sliding)


def align_rows(left: DataFrame, right: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """The same alignment for long lists kept as rows: (keys, i, a, b).

    left/right: keys, a dense 0-based ``index``, ``value``. Index arithmetic turns the
    alignment into equi-joins on (keys, index), so a long list is spread over tasks.
    """
    size = lambda d, n: d.groupBy(*keys).agg((F.max(index) + 1).alias(n))
    sizes = size(left, "__nl").join(size(right, "__nr"), keys)
    n = F.greatest("__nl", "__nr")

    def side(d: DataFrame, own: str, out: str) -> DataFrame:
        # row j serves every i with floor(i * own / n) == j
        first = F.ceil(F.col(index) * n / F.col(own))
        last = F.ceil((F.col(index) + 1) * n / F.col(own)) - 1
        return d.join(sizes, keys).select(*keys, F.explode(F.sequence(first, last)).alias("i"), F.col(value).alias(out))

    return side(left, "__nl", "a").join(side(right, "__nr", "b"), [*keys, "i"])


def grounded_pairs(terms: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Pairs whose both sides occur in the cleaned source texts (English without case).

    terms: key, zh, en, ...; documents: key, zh_text, en_text with one row per key. The
    pairs are pre-aggregated, so a pair mined a million times is tested once per document.
    """
    clean = documents.select(key, clean_markdown(F.col("zh_text")).alias("__z"), F.lower(clean_markdown(F.col("en_text"))).alias("__e"))
    terms = terms.withColumns({"zh": strip(F.col("zh")), "en": strip(F.col("en"))}).where((F.col("zh") != "") & (F.col("en") != ""))
    tested = terms.select(key, "zh", "en").distinct().join(clean, key)
    good = tested.where(F.contains("__z", F.col("zh")) & F.contains("__e", F.lower("en"))).select(key, "zh", "en")
    return terms.join(good, [key, "zh", "en"], "left_semi")


def term_frequency(terms: DataFrame) -> DataFrame:
    """(zh, en, count, units, sources, first) per pair, English folded to lower case.

    terms: zh, en, unit, source, ord. A first aggregation on (pair, unit, source) folds
    the copies of a hot pair in many tasks before the pair itself is grouped.
    """
    rows = terms.select(strip(F.col("zh")).alias("zh"), F.lower(strip(F.col("en"))).alias("en"), F.coalesce("unit", F.lit("")).alias("unit"),
                        strip(F.coalesce("source", F.lit(""))).alias("source"), "ord")
    rows = rows.where((F.col("zh") != "") & (F.col("en") != ""))
    part = rows.groupBy("zh", "en", "unit", "source").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    full = part.groupBy("zh", "en").agg(
        F.sum("n").alias("count"), F.min("first").alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(split_units(strip(F.col("unit"))))))).alias("units"),
        F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"),
    )
    return full.select("zh", "en", "count", "units", "sources", "first")


def ranked_terms(terms: DataFrame) -> DataFrame:
    """Most frequent first, then first seen: a range-partitioned sort."""
    return term_frequency(terms).orderBy(F.desc("count"), "first")


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value per key; of equals the one seen first. Two-step aggregation."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def first_keywords(units: DataFrame) -> DataFrame:
    """Every keyword once with the unit that has it first: (keyword, agency, unit).

    units: ord, agency, unit, keywords.
    """
    keep = ["ord", strip(F.coalesce("agency", F.lit(""))).alias("agency"), strip(F.coalesce("unit", F.lit(""))).alias("unit")]
    rows = unnest(units, keep, split_keywords(F.coalesce("keywords", F.lit(""))), "keyword", "k")
    return rows.groupBy("keyword").agg(F.min_by(F.struct("agency", "unit"), F.struct("ord", "k")).alias("o")).select("keyword", "o.agency", "o.unit")


def rule_stems(terms: DataFrame) -> DataFrame:
    """(stem, official, ord) from suffix trimming: 2-4 characters, changed, not a stop word.

    Several terms with one stem: the last one counts, at the place of the first.
    """
    stem = strip(trim_suffix(F.col("term")))
    rows = terms.withColumn("stem", stem).where(
        (F.col("stem") != F.col("term")) & F.length("stem").between(2, 4) & ~F.col("stem").isin(*STEM_STOPWORDS)
    )
    return rows.groupBy("stem").agg(F.max_by("term", "ord").alias("official"), F.min("ord").alias("ord"))


def needs_model(terms: DataFrame) -> DataFrame:
    """Terms the suffix rule says nothing about."""
    stem = strip(trim_suffix(F.col("term")))
    hit = (stem != F.col("term")) & F.length(stem).between(2, 4) & ~stem.isin(*STEM_STOPWORDS)
    return terms.where(~hit)


def unambiguous_stems(candidates: DataFrame, limit: int = MAX_AMBIGUITY) -> DataFrame:
    """(stem, official): stems of at most ``limit`` terms, with the first of them.

    candidates: stem, official, ord.
    """
    grouped = candidates.groupBy("stem").agg(F.count("*").alias("n"), F.min_by("official", "ord").alias("official"))
    return grouped.where(F.col("n") <= limit).select("stem", "official")


def stem_mapping(terms: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Stem to official term: rule stems, then valid model answers (original, stem, ord)."""
    rules = rule_stems(terms).select("stem", "official", F.struct(F.lit(0).alias("s"), F.col("ord").cast("decimal(38,0)").alias("ord")).alias("ord"))
    if answers is None:
        return unambiguous_stems(rules)
    good = answers.withColumn("stem", strip(F.col("stem"))).where(valid_stem(F.col("original"), F.col("stem")))
    model = good.select("stem", F.col("original").alias("official"), F.struct(F.lit(1).alias("s"), F.col("ord").cast("decimal(38,0)").alias("ord")).alias("ord"))
    return unambiguous_stems(rules.unionByName(model))


def valid_aliases(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Model aliases long enough, not a stop word and not a known keyword.

    answers: keyword, alias, ord; known: keyword.
    """
    rows = answers.withColumn("alias", strip(F.col("alias"))).where(valid_alias_shape(F.col("alias")))
    return rows.join(known.select(F.col("keyword").alias("alias")).distinct(), "alias", "left_anti")


def positional_answers(batch: Column, answers: Column) -> Column:
    """Inputs zipped with answers by position; missing answers are empty, extra ones dropped."""
    return F.slice(
        F.zip_with(batch, F.slice(answers, 1, F.size(batch)), lambda k, a: F.struct(k.alias("keyword"), F.coalesce(a, F.array().cast("array<string>")).alias("aliases"))),
        1, F.size(batch),
    )


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Number rows into batches of ``size`` in order of a column.

    Places are counted inside blocks of the global order and the blocks' counts added up, so no task holds more than a block, every batch but
    the last is full, and a stage that runs again gives the same batches.
    """
    placed = row_index(df.withColumn("__all", F.lit(0)), ["__all"], [order], "__at")
    return placed.withColumn("batch", F.floor(F.col("__at") / size).cast("string")).drop("__all", "__at")
