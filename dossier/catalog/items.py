"""Item and numbering queries. Items are document lines under labels chosen by line number."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import query
from dossier.catalog.documents import dcollapse, dstrip
from dossier.functions import html as H
from dossier.functions import ids
from dossier.functions import modeljson as J
from dossier.functions import text as T
from dossier.operators import items as I
from dossier.operators import numbering as N
from dossier.operators.unnest import unnest, unnest_structs
from dossier.plans.breakdown import keyed_segments

_LABELS = ("1.", "(a)", "(b)", "(i)", "(ii)", "(3)", "Part_A 1", "B..2_", "x", "7")


def line_items(t):
    """(doc_id, ord, question_id, question_text)."""
    rows = unnest(t.documents, ["doc_id"], F.split("text", "\n"), "question_text", "ord")
    kind = ((F.col("ord") * 7 + F.col("doc_id")) % 10).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), kind + 1)
    label = F.when(kind == 0, F.concat(F.lit("1."), F.col("ord").cast("string"))).otherwise(label)
    return rows.select("doc_id", F.col("ord").cast("bigint").alias("ord"), label.alias("question_id"), "question_text")


_SQL_LINES = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS question_text FROM documents),
i AS (SELECT doc_id, ord, question_text, (ord * 7 + doc_id) % 10 AS k,
      CASE (ord * 7 + doc_id) % 10 WHEN 0 THEN '1.' || ord WHEN 1 THEN '(a)' WHEN 2 THEN '(b)' WHEN 3 THEN '(i)' WHEN 4 THEN '(ii)' WHEN 5 THEN '(3)' WHEN 6 THEN 'Part_A 1' WHEN 7 THEN 'B..2_' WHEN 8 THEN 'x' ELSE '7' END AS question_id FROM l)
"""


def dqid(x: str) -> str:
    for pattern, repl in (
        (r"(?i)\b(Part|Chapter|Section|Annex|Appendix)_([A-Za-z0-9]+)\b", r"\1 \2"), ("_+", "."), (r"\.+", "."), (r"\s*\.\s*", "."), (r"^[. ]+|[. ]+\z", ""),
        (r"(?i)\b(Part\s+[A-Za-z0-9]+)\s+(\d+)\b", r"\1.\2"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"
    return x


@query(
    "question_id_normalize",
    f"WITH r AS (SELECT doc_id, n, CASE n % 4 WHEN 0 THEN 'Part_' || w WHEN 1 THEN '.. ' || w || '__' || n || ' . 2.' WHEN 2 THEN 'part ' || n || '  ' || n ELSE w END AS x FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS n, unnest(w) AS w FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z0-9 ._]', '', 'g'), ' ') AS w FROM documents))) SELECT doc_id, n, {dqid('x')} AS qid FROM r",
)
def question_id_normalize(t):
    """Words of the documents with id punctuation around them."""
    words = unnest(t.documents, ["doc_id"], F.split(F.regexp_replace("text", "[^A-Za-z0-9 ._]", ""), " "), "w", "n")
    n = F.col("n").cast("string")
    x = (
        F.when(F.col("n") % 4 == 0, F.concat(F.lit("Part_"), "w")).when(F.col("n") % 4 == 1, F.concat(F.lit(".. "), F.col("w"), F.lit("__"), n, F.lit(" . 2.")))
        .when(F.col("n") % 4 == 2, F.concat(F.lit("part "), n, F.lit("  "), n)).otherwise(F.col("w"))
    )
    return words.select("doc_id", "n", ids.normalize_question_id(x).alias("qid"))


def _noisy(t):
    """Every fifth line is a header, notice, blank box or table instead of its text."""
    noise = F.element_at(
        F.array(*[F.lit(x) for x in ("<b>Remarks / Comments</b>", "Note: All questions must be answered", "<p> </p>", "<table><tr><td></td></tr></table>", "General Instructions: read?")]),
        (F.floor(F.col("ord") / 5) % 5 + 1).cast("int"),
    )
    return line_items(t).withColumn("question_text", F.when(F.col("ord") % 5 == 2, noise).otherwise(F.col("question_text")))


@query(
    "false_positive_filter",
    _SQL_LINES + f""", m AS (SELECT doc_id, ord, question_id, CASE WHEN ord % 5 <> 2 THEN question_text ELSE CASE (ord // 5) % 5 WHEN 0 THEN '<b>Remarks / Comments</b>' WHEN 1 THEN 'Note: All questions must be answered' WHEN 2 THEN '<p> </p>' WHEN 3 THEN '<table><tr><td></td></tr></table>' ELSE 'General Instructions: read?' END END AS q FROM i)
    SELECT doc_id, ord, question_id FROM m WHERE {dstrip('q')} <> '' AND NOT (ord % 5 = 2 AND (ord // 5) % 5 IN (0, 1, 2))""",
)
def false_positive_filter(t):
    return I.cleaned(_noisy(t)).select("doc_id", "ord", "question_id")


@query(
    "hierarchy_repair",
    _SQL_LINES + f""", f AS (SELECT *, k IN (0, 6, 7) OR row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1 AS root FROM i),
    g AS (SELECT *, max(CASE WHEN root THEN ord END) OVER w AS r_at, max(CASE WHEN NOT root AND k IN (1, 2) THEN ord END) OVER w AS a_at FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    h AS (SELECT g.doc_id, g.ord, g.question_id AS raw, g.k, g.root, {dqid('r.question_id')} AS root_id, CASE a.k WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS letter, coalesce(a_at, -1) > r_at AS lettered FROM g JOIN i r ON r.doc_id = g.doc_id AND r.ord = r_at LEFT JOIN i a ON a.doc_id = g.doc_id AND a.ord = a_at)
    SELECT doc_id, ord, CASE WHEN root THEN root_id WHEN k IN (3, 4, 8) AND lettered THEN root_id || '.' || letter || '.' || replace(replace(raw, '(', ''), ')', '') ELSE root_id || '.' || replace(replace(raw, '(', ''), ')', '') END AS question_id FROM h""",
)
def hierarchy_repair(t):
    return I.repaired_hierarchy(line_items(t), ["doc_id"], block=None).select("doc_id", "ord", "question_id")


@query(
    "weak_headings",
    _SQL_LINES + f"""SELECT doc_id, ord, '2.' || ord || ' ' || q AS heading FROM (SELECT doc_id, ord, {dstrip('question_text')} AS q FROM i) WHERE NOT contains(q, '?') AND len(q) < 60
      AND regexp_matches(q, '^[A-Z][a-zA-Z0-9{T.WS}\\-_/,&]+\\z') AND NOT regexp_matches(q, '(?i)\\b(please|indicate|provide|describe|specify|state|answer|explain|are|is|do|does|how|what|which)\\b')""",
)
def weak_headings(t):
    rows = line_items(t).select("doc_id", "ord", F.concat(F.lit("2."), F.col("ord").cast("string")).alias("question_id"), "question_text")
    _, heads = I.split_weak_headings(rows.withColumn("question_text", T.strip(F.col("question_text"))))
    return heads.select("doc_id", "ord", "heading")


@query(
    "orphan_parts",
    _SQL_LINES + """, m AS (SELECT doc_id, ord, CASE ord % 4 WHEN 1 THEN question_text || ' see the table below' WHEN 2 THEN '<table><tr><td>' || ord || '</td></tr></table>' ELSE question_text END AS q FROM i)
    SELECT doc_id, ord, CAST(contains(q, '<table') AND coalesce(regexp_matches(lower(p), 'table below|:\\s*\\z') OR (len(regexp_replace(q, '<[^>]+>', '', 'g')) < 5 AND NOT contains(p, '<table')), FALSE) AS INT) AS orphan
    FROM (SELECT *, lag(q) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM m) WHERE ord % 4 = 2""",
)
def orphan_parts(t):
    from dossier.operators.ordered import previous

    q = (
        F.when(F.col("ord") % 4 == 1, F.concat("question_text", F.lit(" see the table below")))
        .when(F.col("ord") % 4 == 2, F.concat(F.lit("<table><tr><td>"), F.col("ord").cast("string"), F.lit("</td></tr></table>"))).otherwise(F.col("question_text"))
    )
    rows = previous(line_items(t).withColumn("q", q), ["doc_id"], ["ord"], {"p": F.col("q")}, block=None)
    return rows.where("ord % 4 = 2").select("doc_id", "ord", ids.is_orphan_part(F.col("q"), F.col("p")).cast("int").alias("orphan"))


@query(
    "part_alignment",
    f"""WITH i AS (SELECT conv_id, turn, CASE WHEN turn = 0 OR (conv_id % 4 = 0 AND turn % 2 = 0) THEN 'Part A.' || turn ELSE 'b.' || turn END AS q FROM conversations),
    s AS (SELECT conv_id, avg(CAST(q LIKE 'Part%' AS INT)) >= 0.3 AS p FROM i GROUP BY 1)
    SELECT conv_id, turn, CASE WHEN p AND q LIKE 'b.%' THEN 'Part B.' || turn ELSE q END AS question_id FROM i JOIN s USING (conv_id)""",
)
def part_alignment(t):
    turn = F.col("turn").cast("string")
    q = F.when((F.col("turn") == 0) | ((F.col("conv_id") % 4 == 0) & (F.col("turn") % 2 == 0)), F.concat(F.lit("Part A."), turn)).otherwise(F.concat(F.lit("b."), turn))
    return I.aligned_part_ids(t.conversations.select("conv_id", "turn", q.alias("question_id")), ["conv_id"])


@query(
    "dedup_concat",
    f"""WITH i AS (SELECT conv_id, role AS question_id, turn AS ord, conv_id || '-' || turn || ' ' || text AS x FROM conversations UNION ALL SELECT conv_id, role, turn + 1000, conv_id || '-' || turn || '  ' || text FROM conversations)
    SELECT conv_id, question_id, min(ord) AS ord, string_agg(x, ' ' ORDER BY ord) AS question_text FROM i WHERE ord < 1000 GROUP BY 1, 2""",
)
def dedup_concat(t):
    """Turns of a role under one id; each turn comes twice with other white space."""
    x = lambda gap: F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(gap), F.col("text"))
    rows = t.conversations.select("conv_id", F.col("role").alias("question_id"), F.col("turn").alias("ord"), x(" ").alias("question_text"))
    again = t.conversations.select("conv_id", F.col("role").alias("question_id"), (F.col("turn") + 1000).alias("ord"), x("  ").alias("question_text"))
    return I.merged_by_id(rows.unionByName(again), ["conv_id"])


@query(
    "continuation_merge",
    """WITH i AS (SELECT conv_id, turn, 'Q' || (turn % 2) AS id, turn || ':' || text AS x, CASE turn % 5 WHEN 4 THEN 'exclude' WHEN 0 THEN 'question' WHEN 3 THEN 'question' ELSE 'continuation' END AS role FROM conversations),
    k AS (SELECT *, max(CASE WHEN role = 'question' THEN turn END) OVER (PARTITION BY conv_id, id ORDER BY turn) AS q, min(turn) OVER (PARTITION BY conv_id, id) AS f FROM i WHERE role <> 'exclude')
    SELECT conv_id, id AS question_id, coalesce(q, f) AS ord, string_agg(x, ' ' ORDER BY turn) AS question_text FROM k GROUP BY 1, 2, 3""",
)
def continuation_merge(t):
    role = F.when(F.col("turn") % 5 == 4, "exclude").when((F.col("turn") % 5).isin(0, 3), "question").otherwise("continuation")
    rows = t.conversations.select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("Q"), (F.col("turn") % 2).cast("string")).alias("question_id"),
                                  F.concat(F.col("turn").cast("string"), F.lit(":"), F.col("text")).alias("question_text"), role.alias("role"))
    return I.merged_continuations(rows, ["conv_id"])


@query("canonicalize_items")
def canonicalize_items(t):
    """Filter, repair, part alignment and the text merge over the lines of every document."""
    done = I.fused(I.canonical_ids(_noisy(t), ["doc_id"], block=None), ["doc_id"])
    return unnest_structs(done, ["doc_id"], "items", ["question_id", "question_text"], "ord").select("doc_id", "ord", "question_id", F.md5("question_text").alias("text_md5"))


@query("question_format")
def question_format(t):
    """Id prefixes off, blanks out, lists and tables to HTML, tags balanced."""
    rows = line_items(t).withColumn("question_text", F.concat("question_id", F.lit(" "), "question_text", F.lit(" ____\n- one\n- two")))
    return rows.select("doc_id", "ord", F.md5(H.format_question_text(F.col("question_text"), F.col("question_id"))).alias("text_md5"))


def _markdown(t):
    """Documents with numbering markers in front of their lines."""
    line = lambda x, i: (
        F.when(i % 12 == 0, F.concat(F.lit("# **I. "), x, F.lit("**")))
        .when(i % 12 == 1, F.concat(F.lit("## **"), (i % 9 + 1).cast("string"), F.lit(". "), x, F.lit("**")))
        .when(i % 12 == 2, F.concat((i % 5).cast("string"), F.lit("."), i.cast("string"), F.lit(" "), x))
        .when(i % 12 == 3, F.concat(F.lit("("), i.cast("string"), F.lit(") "), x))
        .when(i % 12 == 4, F.concat(F.lit("| a. "), x, F.lit(" (i) Measures (ii) Records |")))
        .when((i % 12).isin(6, 7), F.concat(F.lit("| * 1. "), x, F.lit(" |"))).otherwise(x)
    )
    return t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query("numbering_candidates")
def numbering_candidates(t):
    segs = keyed_segments(_markdown(t))
    rows = unnest_structs(segs, ["doc_id", "segment"], "candidates", ["source_key", "question_id", "text", "kind", "source_line"])
    return rows.select("doc_id", "segment", "source_key", "question_id", "kind", "source_line", F.md5("text").alias("text_md5"))


@query(
    "structured_questions",
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {dcollapse("regexp_replace(x, '[|*]', '', 'g')")}), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9.]+$')) AS l FROM documents),
    n AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS x FROM s WHERE len(l) >= 3)
    SELECT doc_id, '7.' || k AS question_id, x AS question_text FROM n""",
)
def structured_questions(t):
    """Lines of a document as the rows of a question table under one chapter."""
    bare = F.transform(F.split("text", "\n"), lambda x: T.collapse(F.regexp_replace(x, r"[|*]", "")))
    kept = F.filter(bare, lambda x: (x != "") & ~x.rlike(r"^[0-9.]+\z"))
    rows = F.transform(kept, lambda x, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), x, F.lit(" |")))
    head = F.array(F.lit("**7. Questions**"), F.lit("| No | Detailed questions |"), F.lit("| --- | --- |"))
    docs = t.documents.select("doc_id", F.array_join(F.concat(head, rows), "\n").alias("text"))
    return N.structured_questions(docs).select("doc_id", "question_id", "question_text")


@query(
    "toc_removal",
    """WITH m AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    k AS (SELECT *, coalesce(list_position(list_transform(l[2:], lambda x: NOT regexp_matches(x, '^[\\s*#_`]*$')), TRUE) - 1, len(l) - 1) AS blank FROM m)
    SELECT doc_id, md5(l[1] || chr(10) || array_to_string(l[2 + blank:], chr(10))) AS text_md5, 4 + blank AS removed FROM k""",
)
def toc_removal(t):
    """A contents block with links and a blank line is put behind the first line of each document; blank lines that follow go with it."""
    l = F.split("text", "\n")
    block = F.array(F.lit("**目次**"), F.lit(""), F.lit("[1. A](#_Toc1)"), F.lit("[2. B](#toc2)"))
    full = F.array_join(F.concat(F.slice(l, 1, 1), block, F.slice(l, 2, F.size(l))), "\n")
    d = t.documents.select("doc_id", full.alias("x"))
    return d.select("doc_id", F.md5(N.without_toc(F.col("x"))).alias("text_md5"), N.toc_lines_removed(F.col("x")).alias("removed"))


@query(
    "json_repair",
    """WITH i AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS x, len(l) AS c FROM (SELECT doc_id, string_split(regexp_replace(text, '["\\\\{}\\[\\]]', '', 'g'), chr(10)) AS l FROM documents))
    SELECT doc_id, n, 'S' || n AS id, x AS title FROM i WHERE doc_id % 2 = 0 OR n < c - 1""",
)
def json_repair(t):
    """Lines as a JSON array; odd documents lose the end of their last object."""
    bare = F.split(F.regexp_replace("text", r'["\\{}\[\]]', ""), "\n")
    full = F.to_json(F.transform(bare, lambda x, i: F.struct(F.concat(F.lit("S"), i.cast("string")).alias("section_id"), x.alias("title"))))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).otherwise(F.left(full, F.length(full) - 3))
    rows = unnest(t.documents, ["doc_id"], J.repair_array(raw), "r", "n")
    return rows.select("doc_id", "n", F.col("r")["section_id"].alias("id"), F.col("r")["title"].alias("title"))


@query(
    "item_validation",
    """SELECT doc_id, n, id AS question_id, x AS question_text FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS x, 'S' || (generate_subscripts(l, 1) - 1) AS id
      FROM (SELECT doc_id, list_transform(string_split(regexp_replace(text, '["\\\\]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l FROM documents)) WHERE x <> ''""",
)
def item_validation(t):
    lines = F.split(F.regexp_replace("text", r'["\\]', ""), "\n")
    raw = F.to_json(F.transform(lines, lambda x, i: F.struct(F.concat(F.lit(" S"), i.cast("string"), F.lit(" ")).alias("question_id"), x.alias("question_text"))))
    rows = t.documents.select("doc_id", J.plain_items(raw, strict=True).alias("p"))
    out = unnest_structs(rows, ["doc_id"], "p.items", ["question_id", "question_text"])
    return out.select("doc_id", F.regexp_extract("question_id", r"S(\d+)", 1).cast("int").alias("n"), "question_id", "question_text")
