"""Readers: questionnaire tables, JSON maps, layout documents, files and file pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import strip
from dossier.operators import ordered as O
from dossier.operators.retrieval import is_active
from dossier.operators.unnest import unnest, unnest_structs
from dossier.session import settled

# Layout classes that carry text.
LAYOUT_CLASSES = ("plain text", "title", "table", "table_footnote")
# Language marks at the end of a file stem.
ZH_MARKS = ("_ch", "_zh", "_chs", "_cht", "_中文", "_繁中", "_簡中")
EN_MARKS = ("_en", "_eng", "_英文")
# Folders and extensions of the document library.
LIBRARY_FOLDERS = ("REGULATION", "GUIDELINE", "QA")
LIBRARY_EXTENSIONS = ("pdf", "docx", "doc", "xlsx", "xls", "md")
# MIME types by image extension.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}


def active_items(items: DataFrame, master_ids: DataFrame | None = None) -> DataFrame:
    """Items that are not soft-deleted, optionally of the given masters."""
    live = items.where(is_active(F.col("is_deleted")))
    return live if master_ids is None else live.join(master_ids, "master_id", "left_semi")


def qa_fields(items: DataFrame, masters: DataFrame) -> DataFrame:
    """Items with the name of their questionnaire, or its key where the name is unknown.

    Only an explicit 0 counts as not deleted here, unlike everywhere else.
    """
    rows = items.where(F.col("is_deleted") == 0).join(masters, "master_id", "left")
    return rows.withColumn("source_name", F.coalesce("master_name", F.col("master_id").cast("string")))


def filled(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is not blank, trimmed."""
    return df.withColumn(column, strip(F.col(column))).where(F.coalesce(column, F.lit("")) != "")


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, ord) of a JSON object of strings, or of one object a line, over all files of the path.

    A file that is not JSON from its start is an empty map; text behind a whole object is an error.
    """
    raw = spark.read.text(path, wholetext=True)
    return json_map_rows(raw, "value")


def json_map_rows(df: DataFrame, column: str) -> DataFrame:
    kind = "map<string,string>"
    text = strip(F.col(column))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    by_line = F.forall(lines, lambda x: x.rlike(r"^\{.*\}\z") & F.from_json(x, kind).isNotNull())
    whole = F.from_json(text, kind)
    # an object with text behind it is no element of a JSON array
    alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>")) == 1
    one = F.when(whole.isNull() | alone, F.map_entries(whole)).otherwise(F.raise_error(F.lit("text behind the JSON object")))
    entries = F.when(by_line, F.flatten(F.transform(lines, lambda x: F.map_entries(F.from_json(x, kind))))).otherwise(one)
    return unnest_structs(df, [], entries, ["key", "value"], "ord")


def large_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, key, value) of large JSON objects, one a file, each read by many tasks; ``value`` is the text of a string, the JSON of anything else.

    The text reader cuts a file at commas, and its byte ranges split the file. Which commas part entries follows from two running values over the pieces in
    file order: quotes in front (an odd number: inside a string), and open brackets in front. Both are scans over blocks, so no task reads a whole object.
    Equal keys all stay, in order. A file whose entries are not all JSON gives none; text behind an object is an error.
    """
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    raw = raw.withColumn("bare", F.regexp_replace("piece", r"\\.", ""))
    quotes = F.length("bare") - F.length(F.replace(F.col("bare"), F.lit('"'), F.lit("")))
    order = ["start", "at"]
    rows = O.running(raw.withColumn("quotes", quotes), ["path"], order, {"before": O.Running(F.col("quotes"), "sum", exclusive=True)})
    # what stands outside of strings: every other part between quotes
    inside = F.col("before") % 2
    outside = F.array_join(F.filter(F.split("bare", '"'), lambda x, i: (i + inside) % 2 == 0), "")
    count = lambda signs: F.length(outside) - F.length(F.regexp_replace(outside, signs, ""))
    rows = rows.withColumns({"inside": inside, "change": count(r"[\[{]") - count(r"[\]}]")})
    rows = O.running(rows, ["path"], order, {"depth": O.Running(F.col("change"), "sum", exclusive=True)})
    opens = (F.col("inside") == 0) & (F.col("depth") <= 1)
    rows = O.running(rows.withColumn("opens", opens), ["path"], order, {"entry": O.Running(F.col("opens").cast("int"), "sum")})
    pieces = rows.groupBy("path", "entry").agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("xs"), F.min(F.struct("start", "at", "depth")).alias("first"), F.max(F.struct("start", "at", F.col("depth") + F.col("change"))).alias("last"))
    text = strip(F.array_join(F.transform("xs", lambda x: x["piece"]), ","))
    begins, ends = F.col("first.depth") == 0, F.col("last.col3") == 0
    body = F.when(begins, F.regexp_replace(text, r"^\{", "")).otherwise(text)
    body = F.when(ends, F.regexp_replace(body, r"\}$", "")).otherwise(body)
    parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>")
    sound = (~begins | text.startswith("{")) & ((parsed.isNotNull() & (F.size(parsed) == 1)) | (begins & ends & (strip(body) == "")))
    found = settled(pieces.select("path", F.col("entry").alias("ord"), parsed.alias("map"), F.coalesce(sound, F.lit(False)).alias("sound"), (begins & (F.col("entry") > 1)).alias("behind")))
    files = found.groupBy("path").agg(F.bool_or("behind").alias("more"), F.bool_and(F.col("sound") | F.col("behind")).alias("whole"))
    kept = found.join(files.where("whole"), "path")
    entries = F.when(F.col("more"), F.raise_error(F.lit("text behind the JSON object"))).otherwise(F.map_entries("map"))
    return unnest_structs(kept, ["path", "ord"], entries, ["key", "value"], "k").drop("k")


def json_list_map_rows(df: DataFrame, column: str) -> DataFrame:
    """(key, value, ord) of a JSON object of string lists."""
    parsed = F.from_json(F.col(column), "map<string,array<string>>")
    rows = unnest(unnest_structs(df, [], F.map_entries(parsed), ["key", "value"], "k"), ["k", "key"], "value", "value", "v")
    return rows.select("key", "value", (F.col("k").cast("bigint") * 2**31 + F.col("v")).alias("ord")).where(F.col("value").isNotNull())


def layout_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, type, text, page, order) of a layout answer.

    Pages count from 1; the order counts every element of the page, kept or not. A page is
    a list of elements or an object that holds the list.
    """
    element = "struct<classification:string,content:string>"
    top = F.from_json(F.col(column), "struct<DocLayoutFieldList:array<string>>")["DocLayoutFieldList"]
    pages = unnest(df, [key], top, "raw", "p")
    as_list = F.from_json("raw", f"array<{element}>")
    as_object = F.from_json("raw", f"struct<elements:array<{element}>>")["elements"]
    elements = F.when(F.col("raw").rlike(r"^\s*\{"), as_object).otherwise(as_list)
    rows = unnest_structs(pages, [key, "p"], elements, ["classification", "content"], "order")
    rows = rows.select(key, F.col("classification").alias("type"), strip(F.col("content")).alias("text"), (F.col("p") + 1).alias("page"), "order")
    return rows.where(F.col("type").isin(*LAYOUT_CLASSES) & (F.col("text") != ""))


def blocks_of(df: DataFrame, key: str, column: str) -> Column:
    """The same blocks as one ordered array per document row, without a shuffle."""
    element = "struct<classification:string,content:string>"
    top = F.from_json(F.col(column), "struct<DocLayoutFieldList:array<string>>")["DocLayoutFieldList"]
    flat = F.flatten(
        F.transform(
            top,
            lambda r: F.coalesce(
                F.when(r.rlike(r"^\s*\{"), F.from_json(r, f"struct<elements:array<{element}>>")["elements"]).otherwise(
                    F.from_json(r, f"array<{element}>")
                ),
                F.array().cast(f"array<{element}>"),
            ),
        )
    )
    kept = F.filter(flat, lambda e: e["classification"].isin(*LAYOUT_CLASSES) & (strip(e["content"]) != ""))
    return F.transform(kept, lambda e: F.struct(e["classification"].alias("type"), strip(e["content"]).alias("text")))


def layout_text(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text): all blocks of a document joined by blank lines."""
    blocks = blocks_of(df, key, column)
    return df.select(key, F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n").alias("text"))


def page_selection(pages: None | str | int | tuple | list) -> tuple[list[int] | None, str]:
    """Requested pages and the suffix they add to a document id; None means all pages."""
    if pages is None or pages == "all":
        return None, ""
    if isinstance(pages, bool):
        raise ValueError("pages must be numbers")
    if isinstance(pages, int):
        if pages <= 0:
            raise ValueError("page numbers start at 1")
        return [pages], f"_page{pages}"
    if not isinstance(pages, (tuple, list)) or not all(isinstance(p, int) for p in pages):
        raise ValueError("pages must be 'all', a number, a (first, last) pair or a list")
    if isinstance(pages, tuple) and len(pages) == 2:
        first, last = pages
        if first <= 0 or last <= 0 or first > last:
            raise ValueError("a page range needs 1 <= first <= last")
        return list(range(first, last + 1)), f"_pages{first}-{last}"
    if any(p <= 0 for p in pages):
        raise ValueError("page numbers start at 1")
    wanted = sorted(set(pages))
    return wanted, "_pages" + "_".join(map(str, wanted))


def select_pages(df: DataFrame, page: str, pages) -> DataFrame:
    wanted, _ = page_selection(pages)
    if wanted is None:
        return df
    if isinstance(pages, tuple) and len(pages) == 2:
        return df.where(F.col(page).between(*pages))
    return df.where(F.col(page).isin(*wanted))


def stem_language(stem: Column) -> Column:
    """Struct(prefix, lang) of a file stem; lang is null when no mark is recognised.

    The longest suffix wins; a bracketed tag at the end counts when there is no suffix.
    """
    low = F.lower(stem)
    marks = sorted([(m, "zh") for m in ZH_MARKS] + [(m, "en") for m in EN_MARKS], key=lambda x: -len(x[0]))
    prefix, lang = None, None
    for mark, code in marks:
        hit, cut = F.endswith(low, F.lit(mark)), F.substr(stem, F.lit(1), F.length(stem) - len(mark))
        prefix = F.when(hit, cut) if prefix is None else prefix.when(hit, cut)
        lang = F.when(hit, code) if lang is None else lang.when(hit, code)
    bracket = r"[（(](en|eng|英文|ch|zh|中文|繁中|chs|cht)[）)]\z"
    tag = F.regexp_extract(low, bracket, 1)
    bare = strip(F.regexp_replace(stem, "(?i)" + bracket, ""))
    zh_tags = [m.lstrip("_") for m in ZH_MARKS]
    prefix = prefix.when(tag != "", bare).otherwise(stem)
    lang = lang.when(tag == "", F.lit(None).cast("string")).when(tag.isin(*zh_tags), "zh").otherwise("en")
    return F.struct(prefix.alias("prefix"), lang.alias("lang"))


def pair_files(files: DataFrame) -> DataFrame:
    """(folder, prefix, zh_path, en_path) of complete pairs; files: folder, stem, path, ord.

    Two files of one language under a prefix: the later one counts.
    """
    tagged = files.withColumn("s", stem_language(F.col("stem"))).select("folder", "path", "ord", "s.prefix", "s.lang")
    tagged = tagged.where(F.col("lang").isNotNull())
    side = lambda code: F.max_by(F.when(F.col("lang") == code, F.col("path")), F.when(F.col("lang") == code, F.col("ord")))
    pairs = tagged.groupBy("folder", "prefix").agg(side("zh").alias("zh_path"), side("en").alias("en_path"))
    return pairs.where(F.col("zh_path").isNotNull() & F.col("en_path").isNotNull())


def top_level_first(files: DataFrame) -> DataFrame:
    """Sub-folders (depth > 0) count only where the top level holds no file at all."""
    has_top = files.where("depth = 0").limit(1).agg((F.count("*") > 0).alias("x")).scalar()
    return files.where((F.col("depth") == 0) | ~has_top)


def library_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(doc_type, path) of the library: type folder anywhere above the file, known extension."""
    kind = F.regexp_extract(path, "(?:^|/)(" + "|".join(LIBRARY_FOLDERS) + ")/", 1)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    return paths.select(kind.alias("doc_type"), path).where((F.col("doc_type") != "") & ext.isin(*LIBRARY_EXTENSIONS))


def scan_library(spark: SparkSession, root: str) -> DataFrame:
    """Contents of every library file, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = library_files(files.select("path"))
    return files.join(kept, "path").select("doc_type", "path", "content")


def image_key(content: Column) -> Column:
    """Cache key of a file: MD5 of its bytes."""
    return F.md5(content)


def cached_pages(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with ``pages``, their cached page images in page order; an empty list on a miss.

    cache: file_md5, page_no, image, one row a page. The list holds one file's pages.
    """
    listed = cache.groupBy("file_md5").agg(F.array_sort(F.collect_list(F.struct("page_no", "image"))).alias("pages"))
    keyed = files.withColumn("file_md5", image_key(F.col("content"))).join(listed, "file_md5", "left")
    return keyed.withColumn("pages", F.coalesce("pages", F.array().cast(listed.schema["pages"].dataType)))


def image_mime(path: Column, given: Column) -> Column:
    """MIME type by extension for images, else the type that was given."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    out = F.when(F.lit(False), given)
    for known, mime in IMAGE_TYPES.items():
        out = out.when(ext == known, mime)
    return out.otherwise(given)


def expand_files(files: DataFrame, converter) -> DataFrame:
    """(path, page_no, image): one row per page from a converter(path, bytes) -> list[bytes].

    The converter (an Office or PDF renderer) lives on the workers; none is bundled.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [
                (p, n, image) for p, raw in zip(batch["path"], batch["content"]) for n, image in enumerate(converter(p, raw), 1)
            ]
            yield pd.DataFrame(rows, columns=["path", "page_no", "image"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, image binary")


def to_markdown(files: DataFrame, converter) -> DataFrame:
    """(path, markdown, error) from a converter(path, bytes) -> str; a failure becomes an error."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for p, raw in zip(batch["path"], batch["content"]):
                try:
                    rows.append((p, converter(p, raw), None))
                except Exception as exc:  # noqa: BLE001 - one bad file must not stop the job
                    rows.append((p, None, str(exc)))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def sheet_markdown(name: Column, header: Column, rows: Column) -> Column:
    """Markdown of one spreadsheet page: a heading and a pipe table, empty cells blank."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    rule = F.transform(header, lambda _: F.lit("---"))
    return F.concat(F.lit("## Sheet: "), name, F.lit("\n\n"), F.array_join(F.concat(F.array(line(header), line(rule)), F.transform(rows, line)), "\n"), F.lit("\n"))


def golden_items(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ordinal, question_id, question_text) of an answer file, flat or sectioned."""
    item = "struct<question_id:string,question_text:string>"
    rows = F.from_json(F.col(column), "array<map<string,string>>")

    def flat(r: Column) -> Column:
        own = F.array(F.struct(r["question_id"].alias("question_id"), r["question_text"].alias("question_text")))
        inner = F.flatten(
            F.transform(
                F.map_values(r),
                lambda v: F.coalesce(F.from_json(v, f"struct<question:array<{item}>>")["question"], F.array().cast(f"array<{item}>")),
            )
        )
        return F.when(F.map_contains_key(r, "question_id"), own).otherwise(inner)

    return unnest_structs(df, [key], F.flatten(F.transform(rows, flat)), ["question_id", "question_text"], "ordinal")
