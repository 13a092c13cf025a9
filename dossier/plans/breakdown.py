"""Questionnaire breakdown: documents or pages to numbered question items.

Three engines share the operators: the source-keyed one (v1), the outline-driven one (v2)
and the page one. Model calls run inside Arrow batches; everything in front of and behind
them is DataFrame work. A failed call is a row with an error, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import modeljson as J
from dossier.functions.chunks import heading_candidates, semantic_chunks
from dossier.functions.html import linearize_tables
from dossier.functions.text import nfkc, strip
from dossier.models import ChatModel, VisionModel, chat, require_items
from dossier.operators import items as I
from dossier.operators import numbering as N
from dossier.operators import outline as L
from dossier.operators.evaluate import key_coverage
from dossier.operators.unnest import unnest, unnest_structs
from dossier.params import BLOCK_LIMIT, VERIFY_BATCH
from dossier.session import checkpoint

OUTLINE_LIMIT = 12_000
OUTLINE_PAGES = 3
_FAR = 2**24  # places inside one segment, batch or page


def prepared(docs: DataFrame, normalize: bool = True, linearize: bool = False) -> DataFrame:
    """(doc_id, text) without table of contents, with canonical characters."""
    text = N.without_toc(F.col("text"))
    text = nfkc(text) if normalize else text
    return docs.select("doc_id", (linearize_tables(text) if linearize else text).alias("text"))


def _joined(parts: list[Column]) -> Column:
    """Prompt parts with a blank line between; null parts vanish."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n\n")


def _markdown(text: Column) -> Column:
    return F.concat(F.lit("<Markdown>\n"), text, F.lit("\n</Markdown>"))


# --- v1: ids owned by the source ---------------------------------------------------------


def keyed_segments(docs: DataFrame, limit: int = BLOCK_LIMIT) -> DataFrame:
    """Segments with their lines and source candidates."""
    return N.with_candidates(N.with_lines(N.segments(semantic_chunks(docs, "text", limit=limit))))


def keyed_prompt() -> Column:
    parent = N.prefix_of(F.col("entry"))
    context = F.when(
        parent != "",
        F.concat(F.lit("<Numbering_Context>\nThe parent number proven by the source is "), parent,
                 F.lit(".\nSub-items continue it and keep every level.\n</Numbering_Context>")),
    )
    one = lambda c: F.format_string(
        '<Candidate source_key="%s" question_id="%s" kind="%s" source_line="%d">%s</Candidate>',
        c["source_key"], c["question_id"], c["kind"], c["source_line"], c["text"],
    )
    listed = F.when(
        F.size("candidates") > 0,
        F.concat(F.lit("<Source_Candidates>\nAnswer with these source keys only.\n"), F.array_join(F.transform("candidates", one), "\n"), F.lit("\n</Source_Candidates>")),
    )
    return _joined([context, listed, _markdown(F.col("text"))])


def with_key_ids(answered: DataFrame) -> DataFrame:
    """Segments with ``items`` (ids fixed by key, source line or prefix) and ``error``."""
    df = answered.withColumn("p", J.keyed_items(F.col("m.answer")))
    known = F.transform("candidates", lambda c: c["source_key"])
    stray = F.exists("p.items", lambda i: (i["source_key"] != "") & ~F.array_contains(known, i["source_key"]))
    error = F.coalesce(F.col("m.error"), F.col("p.error"), F.when(stray, F.lit("unknown source key")))

    def settle(i: Column) -> Column:
        owner = F.try_element_at(F.filter("candidates", lambda c: c["source_key"] == i["source_key"]), F.lit(1))
        keyed = F.when(i["source_key"] != "", owner["question_id"]).otherwise(i["question_id"])
        role = F.when(owner["kind"] == "parent_requirement", "continuation").otherwise(i["role"])
        qid = N.restored_id(keyed, F.col("entry"), F.col("scope_reset"), N.source_id(F.col("scan"), i["question_text"]))
        return F.struct(qid.alias("question_id"), i["question_text"].alias("question_text"), role.alias("role"), i["source_key"].alias("source_key"))

    return df.withColumn("error", error).withColumn("items", F.when(F.col("error").isNull(), F.transform("p.items", settle)))


def breakdown_v1(docs: DataFrame, model: ChatModel, limit: int = BLOCK_LIMIT, normalize: bool = True, keep: bool = False) -> dict[str, DataFrame]:
    """items (doc_id, ord, question_id, question_text), failures, candidates and selected keys, the coverage of the candidates by them
    (missing and repeated keys), and the documents whose every segment failed.

    Documents with a readable question table never reach the model. With ``keep`` the model
    answers are written to the checkpoint folder, so several results read them once.
    """
    ready = prepared(docs, normalize)
    fast = N.structured_questions(ready)
    slow = ready.join(fast.select("doc_id").distinct(), "doc_id", "left_anti")
    asked = with_key_ids(keyed_segments(slow, limit).withColumn("m", chat(keyed_prompt(), model)))
    if keep:
        asked = checkpoint(asked)
    rows = unnest_structs(asked, ["doc_id", "segment"], "items", ["question_id", "question_text", "role"], "ord")
    merged = I.merged_continuations(rows.withColumn("ord", F.col("ord").cast("bigint")), ["doc_id", "segment"], block=None)
    merged = merged.select("doc_id", (F.col("segment").cast("bigint") * _FAR + F.col("ord")).alias("ord"), "question_id", "question_text")
    failures = asked.where(F.col("error").isNotNull()).select("doc_id", "segment", "text", "error")
    selected = unnest_structs(asked, ["doc_id", "segment"], "items", ["source_key"]).where("source_key <> ''")
    candidates = unnest_structs(asked, ["doc_id", "segment"], "candidates", ["source_key", "question_id", "text", "kind", "source_line"])
    return {"items": fast.unionByName(merged), "failures": failures, "selected": selected, "candidates": candidates,
            "coverage": key_coverage(candidates, selected, ["doc_id", "segment"]), "failed": failed_documents(asked)}


def failed_documents(units: DataFrame) -> DataFrame:
    """Documents none of whose units of work (rows with ``error``) succeeded; in one pass, so answers are not asked for twice."""
    return units.groupBy("doc_id").agg(F.bool_and(F.col("error").isNotNull()).alias("lost")).where("lost").select("doc_id")


def require_answers(result: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The result of an engine, or RuntimeError where documents are lost altogether: none of their blocks or pages could be read."""
    lost = result["failed"].orderBy("doc_id").limit(11).collect()
    if lost:
        named = ", ".join(str(r["doc_id"]) for r in lost[:10])
        raise RuntimeError(f"no part could be read of the documents {named}{' and more' if len(lost) > 10 else ''}")
    return result


# --- v2: outline first -------------------------------------------------------------------


def outline_line(candidate: Column) -> Column:
    return F.concat(F.lit("- [pos:"), candidate["pos"].cast("string"), F.lit("] "), candidate["line"])


def outline_prompt(candidates: Column) -> Column:
    return F.concat(F.lit("<Heading_Candidates>\n"), F.array_join(F.transform(candidates, outline_line), "\n"), F.lit("\n</Heading_Candidates>"))


def candidate_slices(docs: DataFrame, limit: int = OUTLINE_LIMIT) -> DataFrame:
    """(doc_id, slice, cand): the heading candidates of a document in slices of about ``limit`` characters of prompt, none left out.

    Candidates of a document come from one row, so its running length is a window over a bounded group.
    """
    rows = unnest_structs(docs.select("doc_id", heading_candidates(F.col("text")).alias("c")), ["doc_id"], "c", ["pos", "line"], "k")
    size = F.length(outline_line(F.struct("pos", "line"))) + 1
    before = F.sum(size).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - size
    cut = rows.withColumn("slice", F.floor(before / limit).cast("int"))
    return cut.groupBy("doc_id", "slice").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "line"))).alias("cand"))


def skeleton(docs: DataFrame, model: ChatModel) -> DataFrame:
    """(doc_id, ord, pos, path, title): outline nodes at the first candidate line with their marker.

    A long list of candidates is asked for slice by slice, and the answers follow each other.
    """
    df = candidate_slices(docs).withColumn("m", chat(outline_prompt(F.col("cand")), model))
    raw = J.strip_fence(F.col("m.answer"))
    df = df.withColumn("nodes", F.when(raw.startswith("["), J.parse_array(raw)))
    rows = unnest(df, ["doc_id", "slice", "cand"], "nodes", "r", "k").where(F.map_contains_key("r", F.lit("canonical_id")))
    get = lambda k: strip(F.coalesce(F.try_element_at("r", F.lit(k)), F.lit("")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("slice", "k")).cast("bigint") - 1
    marked = rows.select("doc_id", "slice", "k", "cand", get("canonical_id").alias("path"), get("heading_title").alias("name"), get("raw_marker").alias("marker"))
    first = F.try_element_at(F.filter("cand", lambda c: (F.col("marker") != "") & F.contains(c["line"], F.col("marker"))), F.lit(1))["pos"]
    # the candidates stay behind: with them, every node would take a whole slice through the shuffle of the window
    found = marked.select("doc_id", "slice", "k", F.coalesce(first, F.lit(0)).cast("bigint").alias("pos"), "path", F.trim(F.concat("path", F.lit(" "), "name")).alias("title"))
    return found.select("doc_id", place.alias("ord"), "pos", "path", "title")


def path_prompt(path: Column, title: Column, body: Column) -> Column:
    scope = F.when(
        path != "",
        F.concat(F.lit("<Active_Ancestor_Path>\nThis text belongs to: "), F.when(title != "", title).otherwise(path),
                 F.lit("\nEvery question id starts with the prefix: "), path, F.lit("\n</Active_Ancestor_Path>")),
    )
    return _joined([scope, body])


def reviewed(items: DataFrame, model: ChatModel, keep_when_empty: bool) -> DataFrame:
    """Items after a review in batches of at most 80; a batch that fails keeps its items.

    items: doc_id, ord, question_id, question_text. Returns (doc_id, batches, ord, ...).
    """
    numbered = L.verification_batches(items, ["doc_id"], ["ord"], VERIFY_BATCH, block=None)
    # at most VERIFY_BATCH rows per group by construction
    groups = numbered.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "question_id", "question_text"))).alias("xs"))
    own = F.transform("xs", lambda x: F.struct(x["question_id"].alias("question_id"), x["question_text"].alias("question_text")))
    groups = groups.withColumn("own", own).withColumn("m", chat(F.to_json("own"), model))
    answer = J.plain_items(F.col("m.answer"), strict=not keep_when_empty)
    groups = groups.withColumn("p", answer)
    usable = F.col("m.error").isNull() & F.col("p.error").isNull() & (F.lit(not keep_when_empty) | (F.size("p.items") > 0))
    groups = groups.withColumn("final", F.when(usable, F.col("p.items")).otherwise(F.col("own")))
    rows = unnest_structs(groups, ["doc_id", "batch"], "final", ["question_id", "question_text"], "k")
    return rows.select("doc_id", "batch", (F.col("batch") * _FAR + F.col("k")).alias("ord"), "question_id", "question_text")


def breakdown_v2(docs: DataFrame, model: ChatModel, outline_model: ChatModel | None = None, review_model: ChatModel | None = None,
                 limit: int = BLOCK_LIMIT, normalize: bool = True, keep: bool = False) -> dict[str, DataFrame]:
    """items and failures of the outline-driven engine; one retry per block."""
    ready = prepared(docs, normalize)
    fields = ["text", "start", "stop", "heading"]
    cut = semantic_chunks(ready, "text", limit=limit)
    blocks = unnest_structs(cut, ["doc_id"], "chunks", fields, "chunk_idx")
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, ord bigint, pos bigint, path string, title string")
    # outline answers are used twice in the as-of join below
    # a text of one block is emptied, not filtered out: the filter would be pushed down and cut every document into blocks once more for each use of its parts
    long = cut.select("doc_id", F.when(F.size("chunks") > 1, F.col("text")).alias("text"))
    nodes = checkpoint(skeleton(long, outline_model)) if outline_model else empty
    placed = L.chunk_paths(blocks, nodes, block=None)
    asked = placed.withColumn("m", chat(path_prompt(F.col("path"), F.col("title"), _markdown(F.col("text"))), model, retries=1, check=require_items))
    asked = asked.withColumn("p", J.plain_items(F.col("m.answer"), strict=True)).withColumn("error", F.coalesce("m.error", "p.error"))
    if keep:
        asked = checkpoint(asked)
    rows = unnest_structs(asked, ["doc_id", "chunk_idx"], "p.items", ["question_id", "question_text"], "k")
    rows = rows.select("doc_id", (F.col("chunk_idx").cast("bigint") * _FAR + F.col("k")).alias("ord"), "question_id", "question_text")
    items = I.merged_by_id(rows, ["doc_id"])
    if review_model is not None:
        checked = reviewed(items, review_model, keep_when_empty=False)
        # ids are merged again only where there was more than one batch; one pass over the answers
        many = F.max("batch").over(Window.partitionBy("doc_id")) > 0
        checked = checked.withColumn("own", F.when(many, F.lit(-1)).otherwise(F.col("ord"))).drop("batch")
        items = I.merged_by_id(checked, ["doc_id", "own"]).drop("own")
    failures = asked.where(F.col("error").isNotNull()).select("doc_id", F.col("chunk_idx").alias("segment"), "text", "error")
    return {"items": items.select("doc_id", "ord", "question_id", "question_text"), "failures": failures, "failed": failed_documents(asked)}


# --- pages -------------------------------------------------------------------------------


def outline_calls(pages: DataFrame, model: VisionModel, prompt: str, first: int | None = None) -> DataFrame:
    """(doc_id, part, answer): the outline model asked about every OUTLINE_PAGES pages of documents with more than one, or about the ``first`` pages only.

    ``prompt`` takes the first and last page shown and the number of pages. No call holds more than OUTLINE_PAGES images.
    """
    total = pages.groupBy("doc_id").agg(F.max("page").alias("total")).where("total > 1")
    wanted = pages if first is None else pages.where(F.col("page") <= first)
    shown = wanted.join(total, "doc_id").groupBy("doc_id", F.floor((F.col("page") - 1) / OUTLINE_PAGES).alias("part"), "total")
    shown = shown.agg(F.array_sort(F.collect_list(F.struct("page", "image"))).alias("xs"))
    text = F.format_string(prompt, F.element_at("xs", 1)["page"].cast("long"), F.element_at("xs", -1)["page"].cast("long"), F.col("total").cast("long"))
    return shown.withColumn("m", chat(text, model, F.transform("xs", lambda x: x["image"]))).select("doc_id", "part", F.col("m.answer").alias("answer"))


def page_skeleton(pages: DataFrame, model: VisionModel, first: int | None = None) -> DataFrame:
    """(doc_id, ord, page, path) from the outlines of all pages of documents with more than one."""
    asked = outline_calls(pages, model, "Pages %d to %d of a questionnaire with %d pages: give their outline.", first)
    rows = unnest(asked, ["doc_id", "part"], J.parse_array(J.strip_fence(F.col("answer"))), "r", "n").where(F.map_contains_key("r", F.lit("canonical_id")))
    get = lambda k: F.try_element_at("r", F.lit(k))
    place = F.col("part").cast("bigint") * _FAR + F.col("n")
    return rows.select("doc_id", place.alias("ord"), F.coalesce(get("page_number").try_cast("int"), F.lit(1)).alias("page"), strip(get("canonical_id")).alias("path"))


def breakdown_pages(pages: DataFrame, model: VisionModel, outline_model: VisionModel | None = None, review_model: ChatModel | None = None) -> dict[str, DataFrame]:
    """items, failures and failed (documents lost altogether) of the page engine; pages: doc_id, page, image."""
    empty = pages.sparkSession.createDataFrame([], "doc_id bigint, ord bigint, page int, path string")
    nodes = checkpoint(page_skeleton(pages, outline_model)) if outline_model else empty
    placed = L.page_paths(pages, nodes).withColumn("path", F.coalesce("path", F.lit("")))
    prompt = path_prompt(F.col("path"), F.lit(""), F.concat(F.lit("Questions of page "), F.col("page").cast("string"), F.lit(".")))
    # read three times below and made of model calls
    asked = checkpoint(placed.withColumn("m", chat(prompt, model, F.array("image"))).withColumn("p", J.plain_items(F.col("m.answer"), strict=False)).select("doc_id", "page", "m", "p"))
    rows = unnest_structs(asked, ["doc_id", "page"], "p.items", ["question_id", "question_text"], "k")
    rows = rows.select("doc_id", (F.col("page").cast("bigint") * _FAR + F.col("k")).alias("ord"), "question_id", "question_text")
    items = I.merged_by_id(rows, ["doc_id"])
    if review_model is not None:
        items = I.merged_by_id(reviewed(items, review_model, keep_when_empty=True).drop("batch"), ["doc_id"])
    units = asked.select("doc_id", F.col("page").alias("segment"), F.coalesce("m.error", "p.error").alias("error"))
    return {"items": items.select("doc_id", "ord", "question_id", "question_text"), "failures": units.where("error IS NOT NULL"), "failed": failed_documents(units)}


def sectioned(items: DataFrame, section: Column | None = None, depiction: Column | None = None) -> DataFrame:
    """One row per section in the answer form: doc_id, section, depiction, questions (array)."""
    name = F.lit("General") if section is None else section
    rows = items.withColumns({"section": name, "depiction": F.lit("") if depiction is None else depiction})
    listed = rows.groupBy("doc_id", "section").agg(F.first("depiction").alias("depiction"), F.array_sort(F.collect_list(F.struct("ord", "question_id", "question_text"))).alias("xs"))
    return listed.select("doc_id", "section", "depiction", F.transform("xs", lambda x: F.struct(x["question_id"].alias("question_id"), x["question_text"].alias("question_text"))).alias("questions"))
