"""Outlines over pages: anchors, as-of ancestors, section order, calibration, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.ids import bounded_page
from dossier.operators import ordered as O

# Vertical positions on a page, in order.
POSITIONS = {"top": 0, "middle": 1, "bottom": 2}


def position_rank(position: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(position, F.lit(""))))
    out = F.when(F.lit(False), 0)
    for name, rank in POSITIONS.items():
        out = out.when(low == name, rank)
    return out.otherwise(3)


def with_ends(anchors: DataFrame, doc: str = "doc_id", block: int = O.BLOCK) -> DataFrame:
    """End page of each anchor: the page before the next start, never before its own start.

    anchors: doc, ord, id, start_page, total_pages; anchors of one page follow each other by ord, then by id.
    """
    nxt = O.following(anchors, [doc], ["start_page", "ord", "id"], {"__next": F.col("start_page")}, block)
    end = F.coalesce(F.greatest(F.col("start_page"), F.col("__next") - 1), F.col("total_pages"))
    return nxt.withColumn("end_page", end).drop("__next")


def toc_anchors(entries: DataFrame, doc: str = "doc_id", block: int = O.BLOCK) -> DataFrame:
    """(doc, ord, id, title, start_page, end_page, total_pages) from outline entries.

    entries: doc, ord, id, title, page (text), total_pages. Entries without an id are left out.
    """
    usable = entries.where(F.coalesce("id", F.lit("")) != "")
    placed = usable.select(doc, "ord", F.trim("id").alias("id"), F.trim(F.coalesce("title", F.lit(""))).alias("title"),
                           bounded_page(F.col("page"), F.col("total_pages")).alias("start_page"), "total_pages")
    return with_ends(placed, doc, block)


def active_anchor(pages: DataFrame, anchors: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Pages with the first anchor that covers them, else the last anchor of the document."""
    ranked = anchors.withColumn("rank", F.struct("start_page", "ord"))
    covered = O.interval_first(pages, ranked, [doc], page, "start_page", "end_page", "rank", ["id"])
    last = anchors.groupBy(doc).agg(F.max_by("id", F.struct("start_page", "ord")).alias("__last"))
    return covered.join(last, doc, "left").withColumn("id", F.coalesce("id", "__last")).drop("__last")


def calibrated(anchors: DataFrame, found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Anchors after chapters were really seen: moved to the seen page, or inserted.

    found: doc, id, title, page. All chapters of a page take effect, the last sighting of a
    chapter counts. Inserted anchors sort behind the known ones of the same page.
    """
    seen = found.withColumn("__id", F.lower(F.trim("id"))).where(F.col("__id") != "")
    seen = seen.groupBy(doc, "__id").agg(F.max_by(F.struct("id", "title", "page"), "page").alias("s"))
    known = anchors.drop("end_page").withColumn("__id", F.lower("id")).join(seen, [doc, "__id"], "left")
    moved = known.withColumns(
        {
            "is_calibrated": F.coalesce(F.col("s.page") != F.col("start_page"), F.lit(False)),
            "start_page": F.coalesce("s.page", "start_page"),
            "title": F.when(F.coalesce("title", F.lit("")) == "", F.coalesce("s.title", F.lit(""))).otherwise(F.col("title")),
        }
    ).drop("s", "__id")
    totals = anchors.groupBy(doc).agg(F.max("total_pages").alias("total_pages"), F.max("ord").alias("__top"))
    fresh = seen.join(anchors.select(doc, F.lower("id").alias("__id")), [doc, "__id"], "left_anti").join(totals, doc)
    added = fresh.select(doc, (F.col("__top") + F.col("s.page")).alias("ord"), F.trim("s.id").alias("id"), F.trim(F.coalesce("s.title", F.lit(""))).alias("title"),
                         F.col("s.page").alias("start_page"), "total_pages", F.lit(True).alias("is_calibrated"))
    return with_ends(moved.unionByName(added), doc)


def page_paths(pages: DataFrame, nodes: DataFrame, doc: str = "doc_id", block: int = O.BLOCK) -> DataFrame:
    """Active chapter of each page; pages in front of the first node get the first node.

    pages: doc, page; nodes: doc, ord, page, path.
    """
    out = O.as_of(pages, nodes.withColumnRenamed("page", "__p"), [doc], "page", "__p", "ord", ["path"], block)
    return _or_first(out, nodes, doc, F.struct("page", "ord"), ["path"])


def chunk_paths(chunks: DataFrame, nodes: DataFrame, doc: str = "doc_id", block: int = O.BLOCK) -> DataFrame:
    """Active heading of each chunk by character offset.

    chunks: doc, chunk_idx, start, heading; nodes: doc, ord, pos, path, title. Nodes are
    read in their own order and reading stops at the first one behind the chunk, so a node
    counts from the largest offset up to it. A document without nodes passes the heading
    of the chunk in front.
    """
    reach = O.running(nodes, [doc], ["ord"], {"__reach": O.Running(F.col("pos"))}, block)
    out = O.as_of(chunks, reach, [doc], "start", "__reach", "ord", ["path", "title"], block)
    out = O.previous(out, [doc], ["chunk_idx"], {"__prev": F.col("heading")}, block)
    first = nodes.groupBy(doc).agg(F.min_by(F.struct("path", "title"), "ord").alias("__first"))
    out = out.join(first, doc, "left")
    known = F.col("__first").isNotNull()
    return out.withColumns(
        {
            "path": F.coalesce("path", "__first.path", F.when(~known, F.col("__prev")), F.lit("")),
            "title": F.coalesce("title", "__first.title", F.lit("")),
        }
    ).drop("__prev", "__first")


def _or_first(out: DataFrame, nodes: DataFrame, doc: str, order: Column, columns: list[str]) -> DataFrame:
    first = nodes.groupBy(doc).agg(F.min_by(F.struct(*columns), order).alias("__first"))
    out = out.join(first, doc, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col("__first")[c]) for c in columns}).drop("__first")


def filled_pages(pages: DataFrame, entries: DataFrame, doc: str = "doc_id", block: int = O.BLOCK) -> DataFrame:
    """Outline entries of every page: its own, or the last entry of the last page that had any.

    pages: doc, page; entries: doc, page, ord, section_id, subsection_id, title, position,
    is_major, depiction. A carried entry covers the full page and is not major.
    """
    fields = ["section_id", "subsection_id", "title", "position", "is_major", "depiction"]
    per_page = entries.groupBy(doc, "page").agg(F.max_by(F.struct(*fields), "ord").alias("last"))
    marked = pages.join(per_page, [doc, "page"], "left").withColumn("own", F.col("last").isNotNull())
    carried = O.carry_forward(marked, [doc], ["page"], {"c": F.col("last")}, block)
    moved = F.col("c").withField("position", F.lit("full_page")).withField("is_major", F.lit(False))
    gaps = carried.where(~F.col("own") & F.col("c").isNotNull()).select(doc, "page", F.lit(0).alias("ord"), moved.alias("c")).select(doc, "page", "ord", "c.*")
    own = entries.join(pages, [doc, "page"], "left_semi").select(doc, "page", "ord", *fields)
    return own.unionByName(gaps)


def section_order(entries: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, section_id, place, depiction): valid sections by page and position.

    The depiction is that of the first entry, or of the first later one that has any.
    entries: doc, page, position, ord, section_id, depiction, invalid.
    """
    ok = entries.where(~F.col("invalid")).withColumn("at", F.struct("page", position_rank(F.col("position")).alias("r"), "ord"))
    once = ok.groupBy(doc, "section_id").agg(
        F.min("at").alias("at"), F.min_by("depiction", F.when(F.coalesce("depiction", F.lit("")) != "", F.col("at"))).alias("depiction")
    )
    place = F.row_number().over(Window.partitionBy(doc).orderBy("at"))
    return once.select(doc, "section_id", place.alias("place"), F.coalesce("depiction", F.lit("")).alias("depiction"))


def reordered_sections(outline: DataFrame, on_pages: DataFrame, known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, section_id, place): sections by first page and position over both sources.

    A known section that appears nowhere goes behind the last page, in its known order.
    outline/on_pages: doc, section_id, page, position; known: doc, section_id, ord.
    """
    seen = outline.select(doc, "section_id", "page", "position").unionByName(on_pages.select(doc, "section_id", "page", "position"))
    seen = seen.where(F.coalesce("section_id", F.lit("")) != "")
    coord = seen.groupBy(doc, "section_id").agg(F.min(F.struct("page", position_rank(F.col("position")).alias("r"))).alias("at"))
    last = seen.groupBy(doc).agg(F.max("page").alias("__last"))
    names = known.where(F.coalesce("section_id", F.lit("")) != "").groupBy(doc, "section_id").agg(F.min("ord").alias("known_ord"))
    every = names.join(coord, [doc, "section_id"], "full_outer").join(last, doc, "left")
    behind = F.coalesce("__last", F.lit(1)) + 1
    key = F.struct(
        F.coalesce(F.col("at.page"), behind).alias("p"), F.coalesce(F.col("at.r"), F.lit(0)).alias("r"),
        F.when(F.col("at").isNull(), F.coalesce("known_ord", F.lit(999))).otherwise(0).alias("k"),
        F.coalesce("known_ord", F.lit(2**31 - 1)).alias("o"), F.col("section_id").alias("s"),
    )
    return every.select(doc, "section_id", F.row_number().over(Window.partitionBy(doc).orderBy(key)).alias("place"))


def first_appearance(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, section_id, page, idx): where each section shows up first."""
    at = items.groupBy(doc, "section_id").agg(F.min(F.struct("page", "idx")).alias("at"))
    return at.select(doc, "section_id", "at.page", "at.idx")


def after_transition(items: DataFrame, matches: Column, keys: list[str], order: str, out: str = "after") -> DataFrame:
    """Whether an item stands at or behind the first item of its group that matches.

    Groups without a match give null.
    """
    first = items.groupBy(*keys).agg(F.min(F.when(matches, F.col(order))).alias("__t"))
    return items.join(first, keys, "left").withColumn(out, F.col(order) >= F.col("__t")).drop("__t")


def verification_batches(items: DataFrame, keys: list[str], order: list[str], size: int, block: int = O.BLOCK) -> DataFrame:
    """Consecutive batches of ``size`` items per group: adds ``batch``."""
    numbered = O.row_index(items, keys, order, "__i", block)
    return numbered.withColumn("batch", F.floor(F.col("__i") / size)).drop("__i")
