"""Text, chunking, source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import query
from dossier.functions import chunks as C
from dossier.functions import html as H
from dossier.functions import text as T
from dossier.operators.unnest import unnest, unnest_structs
from dossier.params import DOC_TYPES, UPLOAD_EXTENSIONS, ChunkParams
from dossier.plans.ingest import ingest_records as plan_ingest_records
from dossier.plans.ingest import headed
from dossier.sources import readers, sinks

WS = T.WS
# DuckDB forms shared by the oracles
def dstrip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def dcollapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def dnorm(x: str) -> str:
    return f"regexp_replace({x}, '[" + T.MATCH_DROP.replace("'", "''") + "]+', '', 'g')"


def dsanitize(x: str) -> str:
    return dstrip(rf"regexp_replace({x}, '{T.CONTROL}', '', 'g')")


def dchunks(source: str, key: str, text: str, size: int, overlap: int, blank: bool = True) -> str:
    """Chunks by start offset and substring, the textbook form."""
    step = size - overlap
    return f"""
    SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS chunk_idx, piece AS chunk_text FROM (
      SELECT {key}, i, len(t) AS n, {dstrip(f"substr(t, i * {step} + 1, {size})")} AS piece
      FROM (SELECT {key}, t, unnest(range(0, CASE WHEN len(t) <= {size} THEN 1 ELSE CAST(ceil((len(t) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i
            FROM (SELECT {key}, {dstrip(text)} AS t FROM {source} WHERE {text} <> '')))
    WHERE piece <> '' OR ({'TRUE' if blank else 'FALSE'} AND n = 0)"""


@query("sliding_window_chunks", dchunks("documents", "doc_id", "text", 500, 50))
def sliding_window_chunks(t):
    return unnest(t.documents, ["doc_id"], C.sliding_chunks(F.col("text")), "chunk_text", "chunk_idx")


@query("mining_chunks", dchunks("documents", "doc_id", "text", 2000, 300, blank=False))
def mining_chunks(t):
    pieces = C.sliding_chunks(F.col("text"), ChunkParams(2000, 300), keep_blank=False)
    return unnest(t.documents, ["doc_id"], pieces, "chunk_text", "chunk_idx")


@query(
    "macro_chunks",
    f"""WITH src AS (SELECT doc_id, regexp_replace(text, '(?m)^([^a-z\\n]{{1}}[a-z]{{2}} )', '# \\1', 'g') AS t FROM documents),
    parts AS (SELECT doc_id, unnest(string_split(m, chr(1))[2:]) AS p, generate_subscripts(string_split(m, chr(1))[2:], 1) AS s
              FROM (SELECT doc_id, regexp_replace(t, '(?m)^(#{{1,2}}[{WS}])', chr(1) || '\\1', 'g') AS m FROM src) WHERE m LIKE '%' || chr(1) || '%'
              UNION ALL SELECT doc_id, t, 0 FROM src WHERE NOT regexp_matches(t, '(?m)^#{{1,2}}[{WS}]')),
    cut AS (SELECT doc_id, s, i, {dstrip("substr(q, i * 3000 + 1, 3000)")} AS piece
            FROM (SELECT doc_id, s, q, unnest(range(0, CAST(ceil(len(q) / 3000.0) AS BIGINT))) AS i
                  FROM (SELECT doc_id, s, CASE WHEN s = 0 THEN p ELSE {dstrip("p")} END AS q FROM parts)))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, i) - 1 AS chunk_idx, piece AS chunk_text FROM cut WHERE piece <> ''""",
)
def macro_chunks(t):
    """Lines that open with a two-letter word are turned into headings, as the texts have none."""
    marked = F.regexp_replace("text", r"(?md)^([^a-z\n]{1}[a-z]{2} )", "# $1")
    return unnest(t.documents.select("doc_id", marked.alias("t")), ["doc_id"], C.macro_chunks(F.col("t")), "chunk_text", "chunk_idx")


@query(
    "semantic_chunks",
)
def semantic_chunks(t):
    marked = t.documents.select("doc_id", F.regexp_replace("text", r"(?md)^([^a-z\n]{1}[a-z]{2} )", "# $1").alias("t"))
    fields = ["text", "start", "stop", "heading"]
    rows = unnest_structs(C.semantic_chunks(marked, "t"), ["doc_id"], "chunks", fields, "chunk_idx")
    return rows.select("doc_id", "chunk_idx", "start", "stop", "heading", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


_CANDIDATE = rf"(?im)^(#{{1,6}}[{WS}]+.+|\*\*[^*]+\*\*|(?:Part|Section|Chapter|Annex|Appendix)[{WS}]+[A-Z0-9]+.*)$"


@query(
    "heading_candidates",
    rf"""WITH src AS (SELECT doc_id, regexp_replace(text, '(?m)^([^a-z\n]{{1}}[a-z]{{2}} )', '# \1', 'g') AS t FROM documents),
    parts AS (SELECT doc_id, regexp_extract_all(t, '{_CANDIDATE}') AS hits, regexp_split_to_array(t, '{_CANDIDATE}') AS gaps FROM src),
    each_ AS (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM parts WHERE len(hits) > 0),
    placed AS (SELECT doc_id, hit, sum(len(gap)) OVER (PARTITION BY doc_id ORDER BY i)
        + coalesce(sum(len(hit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM each_)
    SELECT doc_id, pos::INT AS pos, line FROM (SELECT doc_id, pos, {dstrip("hit")} AS line FROM placed) WHERE len(line) <= 150""",
)
def heading_candidates(t):
    marked = t.documents.select("doc_id", F.regexp_replace("text", r"(?md)^([^a-z\n]{1}[a-z]{2} )", "# $1").alias("t"))
    return unnest_structs(marked, ["doc_id"], C.heading_candidates(F.col("t")), ["pos", "line"])


def _typed_lines(t):
    """Document lines as layout blocks: the line number decides the class."""
    lines = F.split("text", "\n")
    kind = lambda i: F.when(i % 7 == 0, "title").when(i % 5 == 0, "table").when(i % 11 == 0, "figure").otherwise("plain text")
    element = F.transform(lines, lambda x, i: F.struct(kind(i).alias("classification"), x.alias("content")))
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 10).cast("int")),
        lambda p: F.to_json(F.struct(F.slice(element, p * 10 + 1, 10).alias("elements"))),
    )
    # every other page is a bare list in the source format; both forms appear here
    body = F.concat(F.lit('{"DocLayoutFieldList":['), F.array_join(pages, ","), F.lit("]}"))
    return t.documents.select("doc_id", body.alias("layout"))


_SQL_BLOCKS = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
b AS (SELECT doc_id, i, CASE WHEN i % 7 = 0 THEN 'title' WHEN i % 5 = 0 THEN 'table' WHEN i % 11 = 0 THEN 'figure' ELSE 'plain text' END AS type,
      {dstrip("x")} AS text, i // 10 + 1 AS page, i % 10 AS "order" FROM l)
"""


@query("layout_blocks", _SQL_BLOCKS + """SELECT doc_id, type, text, page, "order" FROM b WHERE type <> 'figure' AND text <> ''""")
def layout_blocks(t):
    return readers.layout_blocks(_typed_lines(t), "doc_id", "layout")


@query(
    "layout_text",
    _SQL_BLOCKS + """SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (WHERE type <> 'figure' AND text <> ''), '') AS text FROM b GROUP BY doc_id""",
)
def layout_text(t):
    return readers.layout_text(_typed_lines(t), "doc_id", "layout")


@query("structure_chunks")
def structure_chunks(t):
    docs = _typed_lines(t)
    blocks = readers.blocks_of(docs, "doc_id", "layout")
    rows = unnest(docs.select("doc_id", blocks.alias("b")), ["doc_id"], C.structure_chunks(F.col("b"), 200, 500, 50), "c", "chunk_idx")
    return rows.select("doc_id", "chunk_idx", F.length("c").alias("n_chars"), F.md5("c").alias("text_md5"))


@query(
    "ingest_records",
    f"""WITH items AS (SELECT conv_id * 100000 + turn AS item_id, CASE role WHEN 'user' THEN 'question' ELSE 'answer' END AS chunk_source, text
                       FROM conversations WHERE role IN ('user', 'assistant')),
    c AS ({dchunks("items", "item_id, chunk_source", "text", 500, 50)})
    SELECT item_id, chunk_source, chunk_idx, {dsanitize("chunk_text")} AS chunk_text,
           CASE WHEN {dsanitize("chunk_text")} = '' THEN 'empty' ELSE {dsanitize("chunk_text")} END AS embed_text,
           octet_length(encode({dsanitize("chunk_text")})) // 4 AS n_tokens FROM c""",
)
def ingest_records(t):
    item = F.col("conv_id") * 100000 + F.col("turn")
    items = t.conversations.where(F.col("role").isin("user", "assistant")).select(
        item.alias("item_id"), F.when(F.col("role") == "user", F.col("text")).alias("title"), F.when(F.col("role") == "assistant", F.col("text")).alias("reply")
    )
    return plan_ingest_records(items)


@query(
    "header_injection",
    f"""WITH c AS ({dchunks("documents", "doc_id", "text", 500, 50)}),
    h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN source ELSE source || ' ' || lang END AS path FROM documents),
    k AS (SELECT doc_id, p FROM (SELECT doc_id, {dsanitize("path")} AS p FROM h))
    SELECT doc_id, chunk_idx, CASE WHEN p <> '' AND NOT contains({dsanitize("chunk_text")}, p) THEN '[' || p || ']' || chr(10) || {dsanitize("chunk_text")}
           ELSE {dsanitize("chunk_text")} END AS chunk_text FROM c JOIN k USING (doc_id)""",
)
def header_injection(t):
    path = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.concat_ws(" ", "source", "lang"))
    # a path may be as long as the text it belongs to, so it is cleaned with the text and not with each of its chunks
    docs = t.documents.select("doc_id", "text", T.sanitize_for_storage(path).alias("path"))
    rows = unnest(docs, ["doc_id", "path"], C.sliding_chunks(F.col("text")), "c", "chunk_idx")
    return rows.select("doc_id", "chunk_idx", headed(F.col("path"), F.col("c")).alias("chunk_text"))


@query("normalize_text", f"SELECT doc_id, {dnorm('text')} AS normalized FROM documents")
def normalize_text(t):
    return t.documents.select("doc_id", T.normalize_for_matching(F.col("text")).alias("normalized"))


@query(
    "sanitize_text",
    f"SELECT page_id, {dsanitize(chr(39) + ' ' + chr(39) + ' || replace(html, ' + chr(39) + 'a' + chr(39) + ', chr(11)) || chr(127)')} AS clean FROM pages",
)
def sanitize_text(t):
    dirty = F.concat(F.lit(" "), F.replace("html", F.lit("a"), F.lit("\x0b")), F.lit("\x7f"))
    return t.pages.select("page_id", T.sanitize_for_storage(dirty).alias("clean"))


def dclean(x: str) -> str:
    for pattern, repl in (
        (rf"(?m)^#{{1,6}}[{WS}]*", ""), (r"\*{2}|_{2}", ""), (r"\*|_", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"<[^>]+>", ""), (rf"(?m)^\|[{WS}\-:|]+\|.*$", ""), (r"`[^`]*`", ""), (r"\|", " "), (r"[\p{Cf}\x{A0}]", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"
    return dcollapse(x)


@query("clean_markdown", f"SELECT doc_id, {dclean('text')} AS clean FROM documents UNION ALL SELECT 1000000000 + page_id, {dclean('html')} FROM pages")
def clean_markdown(t):
    docs = t.documents.select("doc_id", T.clean_markdown(F.col("text")).alias("clean"))
    return docs.unionAll(t.pages.select((F.lit(1000000000) + F.col("page_id")).alias("doc_id"), T.clean_markdown(F.col("html")).alias("clean")))


@query(
    "is_chinese",
    """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(replace(text, 'e', '牛'), 'n', '肉') END AS x FROM documents)
    SELECT doc_id, CAST(len(regexp_replace(x, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) > 0.3 * len(x) AS INT) AS chinese,
           len(regexp_replace(x, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS n_cjk FROM m""",
)
def is_chinese(t):
    """Every other document has two letters replaced by ideographs, as the tables hold no CJK."""
    x = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.translate("text", "en", "牛肉"))
    d = t.documents.select("doc_id", x.alias("x"))
    return d.select("doc_id", T.is_chinese(F.col("x")).cast("int").alias("chinese"), F.length(F.regexp_replace("x", r"[^\x{4E00}-\x{9FFF}]", "")).alias("n_cjk"))


@query(
    "latin_filter",
    """SELECT doc_id, n, CAST(regexp_matches(x, '[A-Za-z]') AS INT) AS latin, CAST(regexp_matches(regexp_replace(x, '[\\x00-\\x7F]', '', 'g'), '\\p{L}') AS INT) AS non_latin
    FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS x FROM documents)
    WHERE len(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 3""",
)
def latin_filter(t):
    lines = unnest(t.documents, ["doc_id"], F.split("text", "\n"), "x", "n").where(T.has_english(F.col("x")))
    return lines.select("doc_id", "n", T.contains_latin(F.col("x")).cast("int").alias("latin"), T.contains_non_latin(F.col("x")).cast("int").alias("non_latin"))


@query("token_estimates", "SELECT doc_id, octet_length(encode(text)) // 4 AS bytes4, len(text) // 2 AS chars2 FROM documents")
def token_estimates(t):
    return t.documents.select("doc_id", T.tokens_bytes4(F.col("text")).alias("bytes4"), T.tokens_chars2(F.col("text")).alias("chars2"))


@query("nfkc_visible")
def nfkc_visible(t):
    return t.documents.select("doc_id", F.md5(T.nfkc(F.col("text"))).alias("text_md5"))


@query(
    "answer_halves",
    f"""WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(10) || '-----' || chr(10)) WHEN 1 THEN replace(text, '. ', '. --- ') ELSE text END AS x FROM documents),
    p AS (SELECT doc_id, x, CASE WHEN regexp_matches(x, '\\n-{{3,}}\\n') THEN strpos(x, chr(10) || '-----' || chr(10)) - 1 WHEN contains(x, '---') THEN strpos(x, '---') - 1 END AS cut,
                 CASE WHEN regexp_matches(x, '\\n-{{3,}}\\n') THEN 7 ELSE 3 END AS w FROM a)
    SELECT doc_id, CASE WHEN cut IS NULL THEN {dstrip('x')} ELSE {dstrip('substr(x, 1, cut)')} END AS english,
           CASE WHEN cut IS NULL THEN {dstrip('x')} ELSE {dstrip('substr(x, cut + w + 1)')} END AS chinese FROM p""",
)
def answer_halves(t):
    x = (
        F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\n-----\n")))
        .when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit(". "), F.lit(". --- ")))
        .otherwise(F.col("text"))
    )
    return t.documents.select("doc_id", T.answer_halves(x).alias("h")).select("doc_id", "h.english", "h.chinese")


def dblanks(x: str) -> str:
    for pattern in H.BLANKS:
        x = f"regexp_replace({x}, '{pattern.replace('(?imd)', '(?im)')}', '', 'g')"
    return dstrip(f"regexp_replace({x}, '\\n[{WS}]*\\n[{WS}]*\\n+', chr(10) || chr(10), 'g')")


_BLANKED = "regexp_replace(replace(html, ' et ', ' [____] '), '([a-z]) [a-z]+#', '\\1 ______ <p>  </p> Answer: [___] ', 'g')"


@query("strip_fill_blanks", f"SELECT page_id, {dblanks(_BLANKED)} AS clean FROM pages")
def strip_fill_blanks(t):
    x = F.regexp_replace(F.replace("html", F.lit(" et "), F.lit(" [____] ")), r"([a-z]) [a-z]+#", "$1 ______ <p>  </p> Answer: [___] ")
    return t.pages.select("page_id", H.strip_fill_blanks(x).alias("clean"))


def _sql_balance() -> str:
    base = dstrip("regexp_replace(html, '</(p|li|td|div)>', '', 'g')")
    for tag in ("script", "style"):
        base = rf"regexp_replace({base}, '(?is)<[{WS}]*{tag}[^>]*>.*?<[{WS}]*/[{WS}]*{tag}[{WS}]*>', '', 'g')"
    gaps = " || ".join(
        rf"repeat('</{g}>', greatest(0, len(regexp_extract_all(x, '(?i)<[{WS}]*{g}(?:[{WS}]+[^>]*)?>')) - len(regexp_extract_all(x, '(?i)<[{WS}]*/[{WS}]*{g}[{WS}]*>'))))"
        for g in H.BALANCED_TAGS
    )
    return f"SELECT page_id, {dstrip('x || ' + gaps)} AS balanced FROM (SELECT page_id, {base} AS x FROM pages)"


@query("html_balance", _sql_balance())
def html_balance(t):
    cut = F.regexp_replace("html", "</(p|li|td|div)>", "")
    return t.pages.select("page_id", cut.alias("x")).select("page_id", H.balance_html(F.col("x")).alias("balanced"))


@query("html_segments")
def html_segments(t):
    rows = unnest(t.pages, ["page_id"], H.html_segments(F.col("html")), "segment", "n")
    return rows.withColumn("chinese", T.is_chinese(F.col("segment")).cast("int"))


@query("html_languages")
def html_languages(t):
    rows = t.pages.select("page_id", H.split_by_language(H.html_segments(F.col("html"))).alias("s"))
    return rows.select("page_id", F.md5("s.zh").alias("zh_md5"), F.md5("s.other").alias("other_md5"))


@query(
    "table_cells",
    f"""SELECT doc_id, n, len(c) AS n_cells, array_to_string(c, '¦') AS cells FROM (
      SELECT doc_id, n, list_filter(list_transform(list_slice(string_split(s, '|'), 2, len(string_split(s, '|')) - 1),
          lambda z: {dstrip("regexp_replace(replace(z, '*', ''), '[" + WS + "]+', ' ', 'g')")}), lambda z: z <> '') AS c
      FROM (SELECT doc_id, n, {dstrip('x')} AS s FROM (
        SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, '| ' || replace(unnest(string_split(text, chr(10))), ' ', ' | ') || ' |' AS x FROM documents)))
    WHERE len(c) > 0""",
)
def table_cells(t):
    """Words of a line as the cells of a pipe row."""
    row = F.concat(F.lit("| "), F.replace("x", F.lit(" "), F.lit(" | ")), F.lit(" |"))
    lines = unnest(t.documents, ["doc_id"], F.split("text", "\n"), "x", "n").select("doc_id", "n", H.table_cells(row).alias("c"))
    return lines.where(F.size("c") > 0).select("doc_id", "n", F.size("c").alias("n_cells"), F.array_join("c", "¦").alias("cells"))


@query("image_key", "SELECT page_id, md5(html) AS file_md5 FROM pages")
def image_key(t):
    return t.pages.select("page_id", readers.image_key(F.col("html").cast("binary")).alias("file_md5"))


@query("page_select", "SELECT conv_id, turn + 1 AS page FROM conversations WHERE turn + 1 BETWEEN 2 AND 4 UNION ALL SELECT conv_id + 1000000000, turn + 1 FROM conversations WHERE turn + 1 IN (1, 5)")
def page_select(t):
    pages = t.conversations.select("conv_id", (F.col("turn") + 1).alias("page"))
    return readers.select_pages(pages, "page", (2, 4)).unionAll(
        readers.select_pages(pages, "page", [5, 1, 5]).select(F.col("conv_id") + 1000000000, "page")
    )


_STEM = "source || '_' || (doc_id % 50)"


@query(
    "file_pairs",
    f"""WITH f AS (SELECT source AS folder, doc_id, {_STEM} || CASE (doc_id // 20) % 6 WHEN 0 THEN '_CHT' WHEN 1 THEN '_EN' WHEN 2 THEN '_中文' WHEN 3 THEN ' (eng)' WHEN 4 THEN '（zh）' ELSE '' END AS stem FROM documents),
    s AS (SELECT folder, doc_id, stem, CASE WHEN lower(stem) LIKE '%\\_cht' ESCAPE '\\' THEN left(stem, len(stem) - 4) WHEN lower(stem) LIKE '%\\_en' ESCAPE '\\' OR stem LIKE '%\\_中文' ESCAPE '\\' THEN left(stem, len(stem) - 3)
              WHEN stem LIKE '% (eng)' THEN trim(left(stem, len(stem) - 5)) WHEN stem LIKE '%（zh）' THEN trim(left(stem, len(stem) - 4)) END AS prefix,
              CASE (doc_id // 20) % 6 WHEN 1 THEN 'en' WHEN 3 THEN 'en' WHEN 5 THEN NULL ELSE 'zh' END AS lang FROM f)
    SELECT folder, prefix, zh_path, en_path FROM (
      SELECT folder, prefix, max(stem) FILTER (WHERE lang = 'zh' AND doc_id = lz) AS zh_path, max(stem) FILTER (WHERE lang = 'en' AND doc_id = le) AS en_path
      FROM (SELECT *, max(CASE WHEN lang = 'zh' THEN doc_id END) OVER (PARTITION BY folder, prefix) AS lz, max(CASE WHEN lang = 'en' THEN doc_id END) OVER (PARTITION BY folder, prefix) AS le FROM s WHERE lang IS NOT NULL)
      GROUP BY folder, prefix) WHERE zh_path IS NOT NULL AND en_path IS NOT NULL""",
)
def file_pairs(t):
    mark = F.element_at(F.array(*[F.lit(m) for m in ("_CHT", "_EN", "_中文", " (eng)", "（zh）", "")]), (F.floor(F.col("doc_id") / 20) % 6 + 1).cast("int"))
    stem = F.concat(F.col("source"), F.lit("_"), (F.col("doc_id") % 50).cast("string"), mark)
    return readers.pair_files(t.documents.select(F.col("source").alias("folder"), stem.alias("stem"), stem.alias("path"), F.col("doc_id").alias("ord")))


@query(
    "library_scan",
    """SELECT doc_type, path FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'REGULATION' WHEN 1 THEN 'GUIDELINE' WHEN 2 THEN 'QA' ELSE '' END AS doc_type,
      '/lib/' || CASE page_id % 4 WHEN 0 THEN 'REGULATION' WHEN 1 THEN 'GUIDELINE' WHEN 2 THEN 'QA' ELSE 'OTHER' END || '/sub/' || page_id || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' ELSE '.xls' END AS path, page_id FROM pages)
    WHERE doc_type <> '' AND page_id % 5 <> 2""",
)
def library_scan(t):
    folder = F.element_at(F.array(*[F.lit(m) for m in ("REGULATION", "GUIDELINE", "QA", "OTHER")]), (F.col("page_id") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(m) for m in (".PDF", ".docx", ".txt", ".md", ".xls")]), (F.col("page_id") % 5 + 1).cast("int"))
    paths = t.pages.select(F.concat(F.lit("/lib/"), folder, F.lit("/sub/"), F.col("page_id").cast("string"), ext).alias("path"))
    return readers.library_files(paths)


@query(
    "upload_filter",
    """SELECT page_id, ext, doc_type FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'docx' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'exe' WHEN 5 THEN 'xls' ELSE 'doc' END AS ext,
       CASE page_id % 4 WHEN 0 THEN 'REGULATION' WHEN 1 THEN 'GUIDELINE' WHEN 2 THEN 'QA' ELSE 'NEWS' END AS doc_type, url, html FROM pages)
    WHERE ext IN ('pdf', 'doc', 'docx', 'xlsx', 'xls') AND doc_type <> 'NEWS' AND url <> '' AND html <> ''""",
)
def upload_filter(t):
    ext = F.element_at(F.array(*[F.lit(m) for m in ("pdf", "txt", "docx", "xlsx", "exe", "xls", "doc")]), (F.col("page_id") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(m) for m in (*DOC_TYPES, "NEWS")]), (F.col("page_id") % 4 + 1).cast("int"))
    rows = t.pages.select("page_id", ext.alias("ext"), kind.alias("doc_type"), "url", "html")
    ok = F.col("ext").isin(*UPLOAD_EXTENSIONS) & F.col("doc_type").isin(*DOC_TYPES) & (F.col("url") != "") & (F.col("html") != "")
    return rows.where(ok).select("page_id", "ext", "doc_type")


def _items(t):
    """Orders as questionnaire items of customers; a third has no delete flag."""
    return t.orders.select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("master_id"), F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("int")).otherwise((F.col("o_orderkey") % 4 == 0).cast("int")).alias("is_deleted"),
    )


_SQL_ITEMS = "(SELECT o_orderkey AS item_id, o_custkey AS master_id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_deleted FROM orders)"


@query(
    "soft_delete_scan",
    f"SELECT item_id, master_id, title FROM {_SQL_ITEMS} WHERE (is_deleted IS NULL OR is_deleted = 0) AND master_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def soft_delete_scan(t):
    masters = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("master_id"))
    return readers.active_items(_items(t), masters).select("item_id", "master_id", "title")


@query(
    "coalesce_left_join",
    f"""SELECT item_id, title, coalesce(c.c_name, CAST(i.master_id AS VARCHAR)) AS source_name FROM {_SQL_ITEMS} i
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = i.master_id WHERE i.is_deleted = 0""",
)
def coalesce_left_join(t):
    masters = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("master_id"), F.col("c_name").alias("master_name"))
    return readers.qa_fields(_items(t), masters).select("item_id", "title", "source_name")


@query("projected_scan", "SELECT p_brand, p_type FROM part WHERE p_size > 10")
def projected_scan(t):
    return t.part.where("p_size > 10").select("p_brand", "p_type")


@query(
    "filled_terms",
    f"SELECT doc_id, n, {dstrip('x')} AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE {dstrip('x')} <> ''",
)
def filled_terms(t):
    return readers.filled(unnest(t.documents, ["doc_id"], F.split("text", "\n"), "line", "n"), "line")


@query(
    "chunk_replace",
    f"""WITH c AS ({dchunks("documents", "doc_id", "text", 500, 50)}), n AS ({dchunks("documents", "doc_id", "text", 700, 70)})
    SELECT doc_id, chunk_idx, md5(chunk_text) AS text_md5 FROM c WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id, chunk_idx, md5(chunk_text) FROM n WHERE doc_id % 3 = 0""",
)
def chunk_replace(t):
    """Documents divisible by three are re-chunked with other sizes and replace their old chunks."""
    cut = lambda d, p: unnest(d, ["doc_id"], C.sliding_chunks(F.col("text"), p), "c", "chunk_idx").select("doc_id", "chunk_idx", F.md5("c").alias("text_md5"))
    redo = t.documents.where("doc_id % 3 = 0")
    return sinks.replaced(cut(t.documents, ChunkParams()), cut(redo, ChunkParams(700, 70)), redo.select("doc_id"), "doc_id")


@query(
    "new_terms_anti",
    """SELECT DISTINCT p_name AS zh, p_type AS en FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 47)""",
)
def new_terms_anti(t):
    cand = t.part.select(F.col("p_name").alias("zh"), F.col("p_type").alias("en")).distinct()
    known = t.part.select(F.when(F.col("p_size") > 47, F.col("p_name")).alias("zh"))
    return sinks.new_terms(cand, known).select("zh", "en")


@query(
    "keyword_update",
    """WITH u AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS agency, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS unit, CAST(s_suppkey AS VARCHAR) AS keywords, 'old' AS extended FROM supplier)
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE extended END AS extended FROM u""",
)
def keyword_update(t):
    u = t.supplier.select(
        "s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("agency"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey").cast("string")).alias("unit"),
        F.col("s_suppkey").cast("string").alias("keywords"), F.lit("old").alias("extended"),
    )
    changes = u.where("s_suppkey % 2 = 0").withColumn("extended", F.lit("new"))
    return sinks.updated_keywords(u, changes.select("agency", "unit", "keywords", "extended")).select("s_suppkey", "extended")


@query(
    "dlq_records",
    """SELECT 'needs_review' AS status, 'extract' AS stage, doc_id AS document_id, 0 AS unit_index, 1 AS total_units, 'bad answer' AS error_message,
    'C001' AS candidate_keys, CASE WHEN text <> '' THEN sha256(text) END AS raw_payload_sha256, CASE WHEN text <> '' THEN text END AS raw_payload FROM documents""",
)
def dlq_records(t):
    d = t.documents.select(F.col("doc_id").alias("document_id"), "text", F.lit(0).alias("unit_index"), F.lit(1).alias("total_units"))
    return sinks.dead_letters(d, "extract", "text", F.lit("bad answer"), F.lit("C001"), include_raw=True)


@query(
    "query_log_rows",
    f"""SELECT conv_id, turn, {dsanitize("text || chr(1)")} AS question FROM conversations WHERE role = 'user'""",
)
def query_log_rows(t):
    rows = t.conversations.where("role = 'user'").select("conv_id", "turn", F.concat("text", F.lit("\x01")).alias("question"))
    return sinks.query_log(rows).drop("log_id", "created_at")


@query(
    "golden_flatten",
    """SELECT conv_id, turn AS ordinal, role || turn AS question_id, text AS question_text FROM conversations WHERE conv_id % 2 = 0
    UNION ALL SELECT conv_id, turn, role || turn, text FROM conversations WHERE conv_id % 2 = 1""",
)
def golden_flatten(t):
    """Each conversation becomes an answer file, sectioned for odd ids, and is read back."""
    rows = t.conversations.select("conv_id", F.struct("turn", F.concat("role", F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question_text")).alias("i"))
    # a file holds one conversation; the turns of a file are that file's content
    files = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("i")), lambda x: F.struct(x["question_id"].alias("question_id"), x["question_text"].alias("question_text"))).alias("q"))
    sectioned = F.to_json(F.array(F.create_map(F.lit("S"), F.struct(F.lit("").alias("depiction"), F.col("q").alias("question")))))
    files = files.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json("q")).otherwise(sectioned).alias("j"))
    return readers.golden_items(files, "conv_id", "j")
