"""Sequential page reading: each page is read with what the pages before it left behind.

All documents advance together, some pages a round; a document's navigation state (anchors,
sections, pending text) is a row. What a page said is put out as a row; cleaning,
numbering, section assignment and the final reduction are DataFrame work on those rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import ids
from dossier.functions import pagereading as P
from dossier.functions import sections as S
from dossier.functions.html import format_question_text
from dossier.functions.modeljson import parse_array, repair_array, strip_fence
from dossier.functions.text import strip
from dossier.models import ChatModel, VisionModel, chat, in_order
from dossier.operators import items as I
from dossier.operators import outline as L
from dossier.operators.unnest import unnest_structs
from dossier.params import VERIFY_BATCH
from dossier.plans.breakdown import outline_calls
from dossier.session import checkpoint, settled, shared_folder


def outline_answers(pages: DataFrame, model: VisionModel, first: int | None = None) -> DataFrame:
    """(doc_id, outline): table of contents of all pages, or of the ``first`` ones; asked for in slices, entries that slices share are kept once."""
    asked = outline_calls(pages, model, "Give the table of contents of these pages (%d to %d of %d), or [] when there is none.", first)
    parts = asked.select("doc_id", "part", F.transform(repair_array(strip_fence(F.col("answer"))), lambda e: F.to_json(e)).alias("entries"))
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "entries"))).alias("xs"))
    entries = F.array_distinct(F.flatten(F.transform("xs", lambda x: F.coalesce(x["entries"], F.array().cast("array<string>")))))
    return listed.select("doc_id", F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]")).alias("outline"))


#: A round takes as many next pages of a document as these bytes hold, a page counting as the share of them that leaves ROUND_PAGES pages a round at most.
ROUND_BYTES, ROUND_PAGES = 4 * 2**20, 512
#: Rows that a task hands on at a time.
_ROWS_OUT = 1_000

_ROUND = P.ROWS + ", state string, step string"
_ROUND_COLUMNS = [*P.COLUMNS, "state", "step"]
#: What a round reads of a document, in this order: its state, earlier pages asked for, the pages to read.
_STATE, _SEEN, _PAGE = 0, 1, 2


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Rows of one document after the other."""
    rows = (row for batch in batches for row in batch.itertuples(index=False))
    for _, own in groupby(rows, key=attrgetter("doc_id")):
        yield list(own)


def _read_on(rows: list, model: VisionModel) -> list[tuple]:
    """Rows of a document's pages up to the last one, or up to one that asks for a page that is not at hand; the last row carries the state.

    A page whose request is open gives a row with its step, and no page behind it is read.
    """
    start, out = rows[0], []
    state, step = P.Reader.load(start.state), P.Step.load(start.step) if start.step else None
    images = {r.page: r.image for r in rows if r.kind != _STATE}
    # pages missing in the document are known to be missing once they have been looked for
    looked_for = set(step.back) if step else set()
    told = {r.page: P.remembered(r.page, r.active, r.answer, r.pending) for r in rows if r.kind == _SEEN and r.answer is not None}
    pages = [r for r in rows if r.kind == _PAGE]
    first = start.first or pages[0].page
    for r in pages:
        if step is None:
            step = P.first_look(state, r.page, r.image, model)
            looked_for |= {p for p in step.back if p >= first}
            if not looked_for.union(images).issuperset(step.back):
                return [*out, (r.doc_id, r.page, *(None,) * 9, step.back, None, state.dump(), step.dump())]
        if step.back:
            shown = [images[p] for p in step.back if p in images]
            P.second_look(state, r.page, step, [*shown, r.image], [told[p] for p in step.back if p in told], model)
        row = P.finish(state, r.page, step)
        told[r.page] = P.remembered(r.page, row[1], row[6], row[7])
        out.append((r.doc_id, r.page, *row, None, None))
        step = None
    return [*out[:-1], (*out[-1][:-2], state.dump(), None)]


def _round(batches: Iterator[pd.DataFrame], model: VisionModel) -> Iterator[pd.DataFrame]:
    """Several documents are read at a time; what is no answer of a model but a fault of ours ends the task."""
    held: list[tuple] = []
    for rows in in_order(partial(_read_on, model=model), _documents(batches)):
        if isinstance(rows, Exception):
            raise rows
        held += rows
        if len(held) >= _ROWS_OUT:
            yield pd.DataFrame(held, columns=_ROUND_COLUMNS)
            held = []
    if held:
        yield pd.DataFrame(held, columns=_ROUND_COLUMNS)


def _begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(state=[P.Reader.start(t, o).dump() for t, o in zip(batch["total"], batch["outline"])])[["doc_id", "rounds", "state"]]


def read_pages(pages: DataFrame, model: VisionModel, outline: DataFrame | None = None) -> DataFrame:
    """One row per page with its answer and the navigation state it was read under.

    pages: doc_id, page, image; outline: doc_id, outline (JSON text). Rows without a document or a page number are left out; of several images of one page any
    one is read.

    Documents are read side by side in rounds. A round takes the next pages of every document, as many as ROUND_BYTES and ROUND_PAGES allow, behind its state.
    Pages that the model wants to see again are mostly among them; where one is not, the document waits at that page, and a further part of the round joins the
    pages asked for by key with their images and with what was read on them, and reads on. Rows and states are written to the shared folder. So a task holds a
    few rounds' pages and no whole document, the number of rounds follows the bytes of the longest one, and a lost executor repeats a round's part.
    """
    spark = pages.sparkSession
    root = f"{shared_folder(spark)}/reading-{uuid.uuid4().hex}"
    known = pages.where("doc_id IS NOT NULL AND page IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("int").alias("page"), "image")
    size = F.greatest(F.coalesce(F.octet_length("image"), F.lit(0)), F.lit(ROUND_BYTES // ROUND_PAGES)).cast("bigint")
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    dealt = known.dropDuplicates(["doc_id", "page"]).withColumn("round", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / ROUND_BYTES).cast("int"))
    # laid out by round, so that a round reads its own pages only; a round without a page, behind a very large one, is no round
    dealt = dealt.withColumn("round", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("round")) - 1)
    dealt.repartitionByRange("round", "doc_id").sortWithinPartitions("round", "doc_id").write.parquet(f"{root}/pages")
    laid = spark.read.schema(dealt.schema).parquet(f"{root}/pages")
    total = laid.groupBy("doc_id").agg(F.max("page").alias("total"), (F.max("round") + 1).alias("rounds"))
    begun = total.join(outline.select("doc_id", "outline"), "doc_id", "left") if outline is not None else total.withColumn("outline", F.lit(None).cast("string"))
    begun.mapInPandas(_begun, "doc_id bigint, rounds int, state string").write.parquet(f"{root}/begun")
    begun = state = spark.read.parquet(f"{root}/begun")
    last = begun.agg(F.max("rounds")).first()[0] or 0
    image = dict((f.name, f.dataType) for f in laid.schema)["image"]
    nothing = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]

    def rows(paths: list[str]) -> DataFrame:
        return spark.read.schema(_ROUND).parquet(*paths)

    def begin(states: DataFrame) -> DataFrame:
        return states.select("doc_id", F.lit(_STATE).alias("kind"), F.lit(0).alias("page"), F.lit(None).cast(image).alias("image"), "first", "state", "step", *nothing("active", "answer", "pending"))

    def to_read(found: DataFrame) -> DataFrame:
        return found.select("doc_id", F.lit(_PAGE).alias("kind"), "page", "image", F.lit(0).alias("first"), *nothing("state", "step", "active", "answer", "pending"))

    written: list[str] = []
    for number in range(last):
        mine = laid.where(F.col("round") == number)
        # in front of the first round there are no pages, so there all that are asked for are at hand or missing
        ready = begin(state.select("doc_id", F.lit(int(number == 0)).alias("first"), "state", *nothing("step"))).union(to_read(mine))
        parts: list[str] = []
        while True:
            path = f"{root}/rounds/{number}-{len(parts)}"
            ready.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "page").mapInPandas(partial(_round, model=model), _ROUND).write.parquet(path)
            parts.append(path)
            open_ = rows([path]).where("step IS NOT NULL")
            if open_.isEmpty():
                break
            start = mine.groupBy("doc_id").agg(F.min("page").alias("first"))
            asked = open_.select("doc_id", F.explode("back_read").alias("page"))
            # pages of the round that were read in an earlier part are at hand again
            again = mine.join(open_.select("doc_id", F.col("page").alias("_open")), "doc_id")
            asked = asked.union(again.where("page < _open").select("doc_id", "page")).distinct()
            told = rows([*written, *parts]).where("step IS NULL").select("doc_id", "page", "active", "answer", "pending")
            seen = asked.join(laid.select("doc_id", "page", "image"), ["doc_id", "page"]).join(told, ["doc_id", "page"], "left")
            seen = seen.select("doc_id", F.lit(_SEEN).alias("kind"), "page", "image", F.lit(0).alias("first"), *nothing("state", "step"), "active", "answer", "pending")
            ready = begin(open_.join(start, "doc_id").select("doc_id", "first", "state", "step")).union(seen).union(to_read(again.where("page >= _open")))
        written += parts
        if number + 1 < last:
            after = rows(parts).where("state IS NOT NULL AND step IS NULL").select("doc_id", "state")
            begun.where(F.col("rounds") > number + 1).select("doc_id", "rounds").join(after, "doc_id").write.parquet(f"{root}/states/{number}")
            state = spark.read.schema(begun.schema).parquet(f"{root}/states/{number}")
    if not last:
        return spark.createDataFrame([], P.ROWS)
    return rows(written).where("step IS NULL").select(*P.COLUMNS)


def page_items(read: DataFrame) -> DataFrame:
    """Items of every page, cleaned, repaired and put into a section: (doc_id, page, k, ...)."""
    found = unnest_structs(
        read.withColumn("r", F.transform(parse_array(F.col("answer")), lambda m: F.struct(
            strip(F.coalesce(F.try_element_at(m, F.lit("question_id")), F.lit(""))).alias("question_id"),
            strip(F.coalesce(F.try_element_at(m, F.lit("question_text")), F.lit(""))).alias("question_text"),
            strip(F.coalesce(F.try_element_at(m, F.lit("section_id")), F.lit(""))).alias("given"),
        ))),
        ["doc_id", "page", "before", "active", "first_new", "changed", "sections"], "r", ["question_id", "question_text", "given"], "k",
    )
    found = found.withColumn("question_text", format_question_text(F.col("question_text"), F.col("question_id")))
    found = found.where("question_id <> '' AND question_text <> ''")
    keys = ["doc_id", "page"]
    rows = I.repaired_hierarchy(I.cleaned(found), keys, "k", F.col("before"), block=None)
    rows, _ = I.split_weak_headings(rows)
    code = S.section_of_id(F.col("question_id"), F.col("sections"))
    opens = (F.col("first_new") != "") & (F.lower("question_id") == F.lower("first_new"))
    belongs = (F.col("by_id") == F.col("active")) | (F.col("given") == F.col("active"))
    page = Window.partitionBy(*keys)
    rows = rows.withColumn("by_id", code)
    turn = F.coalesce(F.min(F.when(opens, F.col("k"))).over(page), F.min(F.when(belongs, F.col("k"))).over(page))
    rows = rows.withColumn("turn", F.when(F.col("changed"), turn))
    after = F.when(F.col("turn").isNotNull(), F.col("k") >= F.col("turn")).otherwise(F.col("changed"))
    return rows.withColumn("section", S.section_for(F.col("question_id"), F.col("given"), F.col("before"), F.col("active"), F.col("sections"), after))


def final_sections(read: DataFrame, items: DataFrame, review_model: ChatModel | None = None) -> DataFrame:
    """(doc_id, place, section, depiction, questions): the finished questionnaire.

    Ids decide the section once more with all sections known; unnamed items go in front of
    the first named section; sections follow their first appearance.
    """
    end = read.groupBy("doc_id").agg(F.max_by(F.struct("sections", "depictions"), "page").alias("z")).select("doc_id", "z.*")
    rows = items.drop("sections").join(end.select("doc_id", "sections"), "doc_id")
    again = F.coalesce(S.section_of_id(F.col("question_id"), F.col("sections")), F.col("section"))
    # read three times below, and the search for sections is the dear part of it
    rows = settled(rows.select("doc_id", again.alias("section"), (F.col("page").cast("bigint") * 2**20 + F.col("k")).alias("ord"), "question_id", "question_text"))
    named = rows.where("section <> ''")
    first = named.groupBy("doc_id").agg(F.min_by("section", "ord").alias("__first"))
    rows = rows.join(first, "doc_id", "left")
    blank = F.col("section") == ""
    rows = rows.withColumns({"section": F.when(blank, F.coalesce("__first", F.lit("General"))).otherwise(F.col("section")), "ord": F.when(blank, F.col("ord") - 2**50).otherwise(F.col("ord"))}).drop("__first")
    keys = ["doc_id", "section"]
    placed = rows.groupBy(*keys).agg(F.min(F.when(F.col("ord") >= 0, F.col("ord"))).alias("at"))
    done = I.fused(I.canonical_ids(rows, keys, block=None), keys)
    if review_model is not None:
        flat = unnest_structs(done, keys, "items", ["question_id", "question_text"], "k").withColumn("batch", F.floor(F.col("k") / VERIFY_BATCH))
        groups = flat.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("k", "question_id", "question_text"))).alias("xs"))
        own = F.transform("xs", lambda x: F.struct(x["question_id"].alias("question_id"), x["question_text"].alias("question_text")))
        groups = groups.withColumn("own", own).withColumn("m", chat(F.to_json("own"), review_model))
        said = F.transform(repair_array(F.col("m.answer")), lambda m: F.struct(F.coalesce(m["question_id"], F.lit("")).alias("question_id"), F.coalesce(m["question_text"], F.lit("")).alias("question_text")))
        said = F.filter(said, lambda i: (i["question_id"] != "") & (i["question_text"] != ""))
        groups = groups.withColumn("said", said).withColumn("final", F.when(F.size("said") > 0, F.col("said")).otherwise(F.col("own")))
        flat = unnest_structs(groups, [*keys, "batch"], "final", ["question_id", "question_text"], "k")
        flat = flat.withColumn("ord", F.col("batch") * 2**20 + F.col("k"))
        done = I.fused(I.canonical_ids(flat.drop("batch", "k"), keys, block=None), keys)
    out = placed.join(done, keys, "left").join(end.select("doc_id", "depictions"), "doc_id", "left")
    questions = F.coalesce("items", F.array().cast("array<struct<question_id:string,question_text:string>>"))
    raw = F.coalesce(F.try_element_at("depictions", F.col("section")), F.lit(""))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("at").asc_nulls_last(), "section"))
    out = out.withColumns({"questions": questions, "place": place})
    return out.select("doc_id", "place", "section", S.introduction_col(raw, F.col("section"), F.transform("questions", lambda q: q["question_text"])).alias("depiction"), "questions")


def breakdown_reading(pages: DataFrame, model: VisionModel, outline_model: VisionModel | None = None, review_model: ChatModel | None = None) -> DataFrame:
    """The whole sequential engine: pages in, sections with questions out."""
    outline = outline_answers(pages, outline_model) if outline_model is not None else None
    # read twice below and made of model calls, so it is settled once in the shared folder
    read = checkpoint(read_pages(pages, model, outline))
    # read several times by the final reduction, so the items of the pages are made once
    return final_sections(read, settled(page_items(read)), review_model)


def outline_map(entries: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """Page map and section order of a raw outline kept as rows.

    entries: doc_id, ord, section_id, subsection_id, title, page (text), position,
    is_major, depiction; pages: doc_id, page.
    """
    total = pages.groupBy("doc_id").agg(F.max("page").cast("int").alias("total"))
    e = entries.join(total, "doc_id")
    title = F.coalesce("title", F.lit(""))
    e = e.withColumn("s", S.outline_entry_col(F.coalesce("section_id", F.lit("")), F.when(F.col("is_major"), title).otherwise(""), F.coalesce("depiction", F.lit(""))))
    raw = F.when(F.coalesce("section_id", F.lit("")) != "", F.col("section_id")).otherwise(F.coalesce("subsection_id", F.lit("")))
    norm = ids.normalize_question_id(raw)
    code = F.when(F.col("s.section_id") == "General", F.when(norm == "", "General").otherwise(norm)).otherwise(F.col("s.section_id"))
    position = F.lower(strip(F.coalesce("position", F.lit("top"))))
    e = e.withColumns(
        {
            "code": code, "page": ids.bounded_page(F.col("page"), F.col("total")),
            "position": F.when(position.isin("top", "middle", "bottom", "full_page"), position).otherwise("top"),
            "depiction": F.when(F.col("is_major"), F.col("s.depiction")).otherwise(F.col("depiction")), "title": title,
        }
    )
    e = e.select("doc_id", "page", "position", "ord", F.col("code").alias("section_id"), F.coalesce(F.when(F.col("subsection_id") != "", F.col("subsection_id")), F.col("code")).alias("subsection_id"),
                 "title", "is_major", "depiction", ids.is_invalid_section(F.col("code"), F.col("title")).alias("invalid"))
    ranked = e.withColumn("ord", L.position_rank(F.col("position")).cast("bigint") * 2**32 + F.col("ord"))
    return {"pages": L.filled_pages(pages, ranked), "order": L.section_order(e), "entries": e}
