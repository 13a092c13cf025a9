"""Scoring extracted items against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import alnum_key

# Recall thresholds of the unified tool and of the engine tools.
UNIFIED_RECALL = 0.95
ENGINE_RECALL = 0.80


def compared(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, question_id, status) with status match, text_mismatch, missing or extra.

    Both sides: case_id, question_id, question_text, ord; of equal ids the last one counts.
    Id lists stay rows, so a case with any number of ids is never gathered in one place.
    """
    last = lambda d, n: d.groupBy("case_id", "question_id").agg(F.max_by("question_text", "ord").alias(n))
    both = last(actual, "a").withColumn("in_a", F.lit(True)).join(
        last(expected, "e").withColumn("in_e", F.lit(True)), ["case_id", "question_id"], "full_outer"
    )
    status = (
        F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "extra")
        .when(alnum_key(F.coalesce("a", F.lit(""))) == alnum_key(F.coalesce("e", F.lit(""))), "match").otherwise("text_mismatch")
    )
    return both.select("case_id", "question_id", status.alias("status"))


def scores(comparison: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 per case; a ratio without a base is 0."""
    is_ = lambda *s: F.sum(F.col("status").isin(*s).cast("int"))
    n = comparison.groupBy("case_id").agg(
        is_("match", "text_mismatch", "missing").alias("expected_count"), is_("match", "text_mismatch", "extra").alias("actual_count"),
        is_("match", "text_mismatch").alias("true_positives"), is_("text_mismatch").alias("text_mismatches"),
        is_("missing").alias("missing"), is_("extra").alias("extra"),
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp = F.col("true_positives")
    n = n.withColumns({"precision": ratio(tp, F.col("actual_count")), "recall": ratio(tp, F.col("expected_count"))})
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def gated(report: DataFrame, min_recall: float = UNIFIED_RECALL) -> DataFrame:
    return report.withColumn("passed", F.col("recall") >= min_recall)


def summary(report: DataFrame, min_recall: float = ENGINE_RECALL) -> DataFrame:
    """One row: number of cases, how many passed, whether all did."""
    ok = F.col("recall") >= min_recall
    return report.agg(F.count("*").alias("cases"), F.sum(ok.cast("int")).alias("passed"), F.coalesce(F.every(ok), F.lit(True)).alias("all_passed"))


def key_coverage(candidates: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_key, status): keys the answer misses, and keys it used more than once.

    A key that no candidate has counts as a duplicate too when it is repeated.
    """
    used = selected.groupBy(*keys, "source_key").agg(F.count("*").alias("n"))
    missing = candidates.select(*keys, "source_key").distinct().join(used, [*keys, "source_key"], "left_anti")
    return missing.withColumn("status", F.lit("missing")).unionByName(
        used.where("n > 1").drop("n").withColumn("status", F.lit("duplicate"))
    )
