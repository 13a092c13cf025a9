"""Question items: hierarchy repair, canonical ids, merging of repeated questions.

Items come in two shapes. Long tables (doc, ord, question_id, question_text) go through
joins, windows over blocks and aggregations. The order-dependent text merge works on the
item list of one answer or section, which already is one row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import ids
from dossier.functions.blocks import merge_fragments
from dossier.functions.text import collapse, let
from dossier.operators import ordered as O

ITEM = T.StructType([T.StructField("question_id", T.StringType()), T.StructField("question_text", T.StringType())])


def joined_texts(texts: Column) -> Column:
    """Texts in order joined by a space; one that is already contained adds nothing."""
    kind = "struct<text:string,flat:string>"
    start = F.struct(F.element_at(texts, 1).alias("text"), collapse(F.element_at(texts, 1)).alias("flat")).cast(kind)

    def add(acc: Column, t: Column) -> Column:
        # the collapsed text grows by the collapsed addition; collapsing the whole anew would make long lists quadratic
        def put(flat: Column) -> Column:
            new = (flat != "") & ~F.contains(acc["flat"], flat)
            joined = F.struct(F.trim(F.concat(acc["text"], F.lit(" "), t)).alias("text"), F.trim(F.concat(acc["flat"], F.lit(" "), flat)).alias("flat"))
            return F.when(new, joined).otherwise(acc).cast(kind)

        return let(collapse(t), put)

    return F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), start, add, lambda a: a["text"])


def merged_by_id(items: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """(keys, question_id, ord, question_text): every id once, at its first place, texts joined.

    Copies of a text under one id are folded by a partial aggregation before the texts of
    the id meet, since a contained text adds nothing. What meets is what the result holds.
    """
    flat = collapse(F.col("question_text"))
    once = items.withColumn("__flat", flat).groupBy(*keys, "question_id", "__flat").agg(
        F.min(F.struct(order, "question_text")).alias("x")
    )
    listed = once.groupBy(*keys, "question_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return listed.select(
        *keys, "question_id", F.element_at("xs", 1)[order].alias(order),
        joined_texts(F.transform("xs", lambda x: x["question_text"])).alias("question_text"),
    )


def merged_continuations(items: DataFrame, keys: list[str], order: str = "ord", block: int | None = O.BLOCK) -> DataFrame:
    """Continuations join the nearest item of their id in front of them; excluded items go.

    items: keys, ord, question_id, question_text, role. Equal ids of questions stay apart.
    """
    kept = items.where(F.col("role") != "exclude")
    group = [*keys, "question_id"]
    head = F.when(F.col("role") != "continuation", F.col(order))
    # place of the entry a row belongs to: its own, or the last question, or the first orphan
    placed = O.running(kept, group, [order], {"__q": O.Running(head), "__first": O.Running(F.col(order), "min")}, block)
    placed = placed.withColumn("__entry", F.coalesce("__q", "__first"))
    listed = placed.groupBy(*group, "__entry").agg(F.array_sort(F.collect_list(F.struct(order, "question_text"))).alias("xs"))
    return listed.select(*group, F.col("__entry").alias(order), joined_texts(F.transform("xs", lambda x: x["question_text"])).alias("question_text"))


def repaired_hierarchy(items: DataFrame, keys: list[str], order: str = "ord", default_parent: Column | None = None, block: int | None = O.BLOCK) -> DataFrame:
    """Bare sub-item labels get the id of their parent: (a) under 1.1 becomes 1.1.a.

    A row is a root when its label is no sub-item label, or when no parent is known yet:
    at the start without a default, or right behind a root whose id is empty. A roman
    hangs on the last letter item since the root, else on the root.
    """
    default = F.trim(F.coalesce(default_parent, F.lit(""))) if default_parent is not None else F.lit("")
    df = items.withColumns({"__kind": ids.sub_item_kind(F.col("question_id")), "__norm": ids.normalize_question_id(F.col("question_id")), "__default": default})
    blank = (F.col("__kind") == "root") & (F.col("__norm") == "")
    df = O.previous(df, keys, [order], {"__after": F.when(blank, 1).otherwise(0)}, block)
    orphan = F.when(F.col("__after").isNull(), F.col("__default") == "").otherwise(F.col("__after") == 1)
    df = df.withColumn("__root", (F.col("__kind") == "root") | orphan)
    place = lambda cond, value: F.when(cond, F.struct(F.col(order).alias("at"), value.alias("v")))
    core = ids.sub_item_core(F.col("question_id"))
    letter = ~F.col("__root") & (F.col("__kind") == "alpha")
    df = O.carry_forward(df, keys, [order], {"__r": place(F.col("__root"), F.col("__norm")), "__a": place(letter, core)}, block)
    root = F.coalesce(F.col("__r.v"), F.col("__default"))
    under = F.when(
        F.col("__a").isNotNull() & (F.coalesce(F.col("__a.at"), F.lit(-1)) > F.coalesce(F.col("__r.at"), F.lit(-(2**62)))),
        F.concat(root, F.lit("."), F.col("__a.v")),
    ).otherwise(root)
    parent = F.when(F.col("__kind") == "roman", under).otherwise(root)
    fixed = F.when(F.col("__root"), F.col("__norm")).otherwise(F.concat(parent, F.lit("."), core))
    return df.withColumn("question_id", fixed).drop("__kind", "__norm", "__default", "__after", "__root", "__r", "__a")


def split_weak_headings(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, headings): short noun phrases under section ids leave the questions."""
    flagged = items.withColumn("__weak", F.coalesce(ids.is_weak_heading(F.col("question_id"), F.col("question_text")), F.lit(False)))
    heads = flagged.where("__weak").withColumn("heading", F.trim(F.concat(F.trim("question_id"), F.lit(" "), F.trim("question_text"))))
    return flagged.where("not __weak").drop("__weak"), heads.drop("__weak")


def aligned_part_ids(items: DataFrame, keys: list[str], block: int | None = O.BLOCK) -> DataFrame:
    """Letter ids become part ids in groups where at least 30% of the ids are part ids."""
    fixed = lambda many: F.when(many, ids.as_part_id(F.col("question_id"))).otherwise(F.col("question_id"))
    if block is None:
        share = F.avg(ids.part_prefixed(F.col("question_id")).cast("int")).over(Window.partitionBy(*keys))
        return items.withColumn("__part", share >= 0.3).withColumn("question_id", fixed(F.col("__part"))).drop("__part")
    share = items.groupBy(*keys).agg((F.avg(ids.part_prefixed(F.col("question_id")).cast("int")) >= 0.3).alias("__part"))
    return items.join(share, keys).withColumn("question_id", fixed(F.col("__part"))).drop("__part")


def cleaned(items: DataFrame) -> DataFrame:
    """Without headers, instructions and blanks."""
    return items.where(~ids.is_false_positive(F.col("question_id"), F.col("question_text")))


def canonical_ids(items: DataFrame, keys: list[str], order: str = "ord", block: int | None = O.BLOCK) -> DataFrame:
    """Canonicalisation up to the text merge: filter, repair, normalise, align part ids."""
    fixed = repaired_hierarchy(cleaned(items), keys, order, block=block)
    fixed = fixed.withColumn("question_id", ids.normalize_question_id(F.col("question_id"))).where("question_id <> '' AND question_text <> ''")
    return aligned_part_ids(fixed, keys, block)


# Phrases that announce a table, as in dossier.functions.ids.
_PROMPT = re.compile(
    r"table\s+below|following\s+table|in\s+the\s+table|as\s+follows|provide\s+details\s+in\s+table|statistics\s+in\s+table|:\s*$"
)


def _expects_table(text: str) -> bool:
    return bool(_PROMPT.search(re.sub(r"<[^>]+>", " ", text).strip().lower()))


def _fuse(rows: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str]]:
    """Merge one item list. Rows carry (id, text, has table or list, little own text).

    A table behind a prompt for one joins that prompt. The same id again joins when it is
    adjacent, else it is kept under id.2 unless its text is already there.
    """
    out: list[list[str]] = []
    place: dict[str, int] = {}
    for qid, text, part, bare in rows:
        if out and part and (_expects_table(out[-1][1]) or (bare and "<table" not in out[-1][1])):
            out[-1][1] = merge_fragments(out[-1][1], text)
        elif qid not in place:
            place[qid] = len(out)
            out.append([qid, text])
        elif place[qid] == len(out) - 1:
            out[-1][1] = merge_fragments(out[-1][1], text)
        elif text.strip() not in out[place[qid]][1]:
            place[f"{qid}.2"] = len(out)
            out.append([f"{qid}.2", text])
    return [(a, b) for a, b in out]


@F.pandas_udf(T.ArrayType(ITEM))
def _fused(lists: pd.Series) -> pd.Series:
    return lists.map(
        lambda xs: [{"question_id": a, "question_text": b} for a, b in _fuse([(x["q"], x["t"], x["part"], x["bare"]) for x in xs])]
    )


def fused_list(items: Column) -> Column:
    """The text merge on an ordered ``array<struct<question_id,question_text>>``."""
    marked = F.transform(
        items,
        lambda i: F.struct(
            i["question_id"].alias("q"), i["question_text"].alias("t"),
            i["question_text"].rlike(r"(?i)<(?:table|ul|ol)\b").alias("part"),
            (F.length(F.trim(F.regexp_replace(i["question_text"], r"<[^>]+>", ""))) < 5).alias("bare"),
        ),
    )
    return _fused(marked)


def fused(items: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """(keys, items): the merged item list of each group.

    The group is one section of one questionnaire: the list gathered here is the value
    the result row holds, and every item of it takes part in the merge.
    """
    listed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "question_id", "question_text"))).alias("xs"))
    items_ = F.transform("xs", lambda x: F.struct(x["question_id"].alias("question_id"), x["question_text"].alias("question_text")))
    return listed.select(*keys, fused_list(items_).alias("items"))
