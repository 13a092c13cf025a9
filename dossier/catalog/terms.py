"""Term mining queries over parts, orders and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dossier.catalog import query
from dossier.catalog.documents import dclean, dstrip
from dossier.functions import text as T
from dossier.operators import terms as M
from dossier.operators.unnest import unnest_structs
from dossier.session import shared_folder
from dossier.sources import readers, sinks


def _terms(t):
    unit = F.concat("p_brand", F.lit("、"), F.col("p_size").cast("string"), F.lit(" / "), F.col("p_type"))
    en = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")))
    return t.part.select(F.concat("p_name", F.lit(" ")).alias("zh"), en.alias("en"), unit.alias("unit"),
                         F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("file"), (F.col("p_partkey") % 7).cast("string"))).alias("source"), F.col("p_partkey").alias("ord"))


_SQL_FREQ = r"""
WITH t AS (SELECT p_partkey AS ord, p_name AS zh, lower(p_type) AS en, string_split_regex(p_brand || '、' || p_size || ' / ' || p_type, '[、,/;\s]+') AS u,
           CASE WHEN p_partkey % 5 <> 0 THEN 'file' || (p_partkey % 7) END AS source FROM part),
n AS (SELECT zh, en, count(*) AS count, min(ord) AS first FROM t GROUP BY 1, 2),
us AS (SELECT zh, en, string_agg(u, '、' ORDER BY u) AS units FROM (SELECT DISTINCT zh, en, unnest(u) AS u FROM t) WHERE u <> '' GROUP BY 1, 2),
ss AS (SELECT zh, en, string_agg(source, ', ' ORDER BY source) AS sources FROM (SELECT DISTINCT zh, en, source FROM t WHERE source IS NOT NULL) GROUP BY 1, 2)
"""


@query("term_frequency", _SQL_FREQ + "SELECT zh, en, count, first, units, coalesce(sources, '') AS sources FROM n JOIN us USING (zh, en) LEFT JOIN ss USING (zh, en)")
def term_frequency(t):
    f = M.ranked_terms(_terms(t))
    return f.select("zh", "en", "count", "first", F.array_join("units", "、").alias("units"), F.array_join("sources", ", ").alias("sources"))


@query("term_export", _SQL_FREQ + 'SELECT zh AS 中文字詞, en AS 英文字詞, count AS 出現頻率, units AS 負責單位, coalesce(sources, \'\') AS 來源檔案 FROM n JOIN us USING (zh, en) LEFT JOIN ss USING (zh, en)')
def term_export(t):
    return sinks.term_export(M.term_frequency(_terms(t)))


@query("large_json_map", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS value FROM part")
def large_json_map(t):
    """Parts as one JSON object, read back piece by piece."""
    path = f"{shared_folder(t.part.sparkSession)}/json-object-{uuid.uuid4().hex}"
    sinks.write_json_object(t.part, "p_partkey", "p_name", path)
    return readers.large_json_map(t.part.sparkSession, path).select("key", "value")


@query("json_map_export", "SELECT '{\"' || p_partkey || '\":\"' || p_name || '\"}' AS value FROM part")
def json_map_export(t):
    return sinks.json_map_text(t.part.select(F.col("p_partkey").cast("string").alias("k"), "p_name"), "k", "p_name")


@query(
    "majority_type",
    """SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS r
      FROM orders GROUP BY 1, 2) WHERE r = 1""",
)
def majority_type(t):
    return M.majority(t.orders, "o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "stem_ambiguity",
    "SELECT p_brand || p_size AS stem, arg_min(p_name, p_partkey) AS official FROM part GROUP BY 1 HAVING count(*) <= 2",
)
def stem_ambiguity(t):
    c = t.part.select(F.concat("p_brand", F.col("p_size").cast("string")).alias("stem"), F.col("p_name").alias("official"), F.col("p_partkey").alias("ord"))
    return M.unambiguous_stems(c, 2)


_SUFFIXES = ("及其製品", "加工品", "", "管理辦法", "等", "規定")


def _cjk_terms(t):
    """Official terms spelled from the part number in CJK digits, with a suffix by size."""
    base = F.translate((F.col("p_partkey") % 300).cast("string"), "0123456789", "零壹貳參肆伍陸柒捌玖")
    suffix = F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), (F.col("p_size") % 6 + 1).cast("int"))
    return t.part.select(F.concat(F.lit("牛"), base, suffix).alias("term"), F.col("p_partkey").alias("ord"))


_SQL_CJK = """
WITH b AS (SELECT p_partkey AS ord, '牛' || translate(CAST(p_partkey % 300 AS VARCHAR), '0123456789', '零壹貳參肆伍陸柒捌玖') AS base, CASE p_size % 6 WHEN 0 THEN '及其製品' WHEN 1 THEN '加工品' WHEN 2 THEN '' WHEN 3 THEN '管理辦法' WHEN 4 THEN '等' ELSE '規定' END AS suf FROM part),
c AS (SELECT ord, base || suf AS term, base AS stem FROM b WHERE suf NOT IN ('', '規定') AND len(base) BETWEEN 2 AND 4)
"""


@query("rule_stems", _SQL_CJK + "SELECT stem, arg_max(term, ord) AS official, min(ord) AS ord FROM c GROUP BY stem")
def rule_stems(t):
    return M.rule_stems(_cjk_terms(t))


@query("stems_for_model", _SQL_CJK + "SELECT ord, base || suf AS term FROM b WHERE ord NOT IN (SELECT ord FROM c)")
def stems_for_model(t):
    return M.needs_model(_cjk_terms(t)).select("ord", "term")


@query(
    "stem_mapping",
    _SQL_CJK + """, r AS (SELECT stem, arg_max(term, ord) AS official, min(ord) AS o, 0 AS s FROM c GROUP BY stem),
    m AS (SELECT left(base, 3) AS stem, base || suf AS official, ord AS o, 1 AS s FROM b WHERE len(left(base, 3)) >= 2 AND ord % 4 = 0)
    SELECT stem, official FROM (SELECT stem, official, row_number() OVER (PARTITION BY stem ORDER BY s, o) AS k, count(*) OVER (PARTITION BY stem) AS n FROM (SELECT * FROM r UNION ALL SELECT * FROM m)) WHERE k = 1 AND n <= 5""",
)
def stem_mapping(t):
    """Suffix stems first, then model answers; here the answer is the first three characters."""
    terms = _cjk_terms(t)
    base = F.regexp_replace("term", "(及其製品|加工品|管理辦法|等|規定)$", "")
    answers = terms.where("ord % 4 = 0").select(F.col("term").alias("original"), F.left(base, F.lit(3)).alias("stem"), "ord")
    return M.stem_mapping(terms, answers)


@query("valid_stems", "SELECT p_partkey, left(p_name, p_size % 6) AS stem FROM part WHERE p_size % 6 >= 2")
def valid_stems(t):
    rows = t.part.select("p_partkey", "p_name", F.expr("left(p_name, p_size % 6)").alias("stem"))
    return rows.where(T.valid_stem(F.col("p_name"), F.col("stem"))).select("p_partkey", "stem")


@query(
    "valid_aliases",
    f"""WITH a AS (SELECT p_partkey AS ord, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN '主管機關' WHEN 2 THEN left(p_name, 1) ELSE ' ' || p_name || ' ' END AS alias FROM part)
    SELECT ord, {dstrip('alias')} AS alias FROM a WHERE len({dstrip('alias')}) >= 2 AND {dstrip('alias')} <> '主管機關' AND {dstrip('alias')} NOT IN (SELECT p_brand FROM part WHERE p_size < 25)""",
)
def valid_aliases(t):
    a = F.element_at(F.array(F.col("p_brand"), F.lit("主管機關"), F.left("p_name", F.lit(1)), F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))), (F.col("p_size") % 4 + 1).cast("int"))
    answers = t.part.select(F.col("p_name").alias("keyword"), a.alias("alias"), F.col("p_partkey").alias("ord"))
    known = t.part.where("p_size < 25").select(F.col("p_brand").alias("keyword"))
    return M.valid_aliases(answers, known).select("ord", "alias")


@query(
    "first_keywords",
    """SELECT w AS keyword, arg_min(p_brand, p_partkey * 10 + i) AS agency, arg_min(p_type, p_partkey * 10 + i) AS unit FROM (
      SELECT p_partkey, p_brand, p_type, unnest(string_split(p_name || ' ' || p_size, ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || p_size, ' '), 1) AS i FROM part) GROUP BY 1""",
)
def first_keywords(t):
    words = F.concat(F.replace("p_name", F.lit(" "), F.lit("、")), F.lit("； "), F.col("p_size").cast("string"))
    return M.first_keywords(t.part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("agency"), F.col("p_type").alias("unit"), words.alias("keywords")))


def _sides(t):
    """The documents of a source in two languages each as the sides to align, told apart by digests of their whole texts."""
    side = lambda *langs: t.documents.where(F.col("lang").isin(*langs)).select("source", "doc_id", F.md5("text").alias("v"))
    return side("en", "es"), side("fr", "de")


@query(
    "align_rows",
    """WITH l AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, md5(text) AS v FROM documents WHERE lang IN ('en', 'es')),
    r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, md5(text) AS v FROM documents WHERE lang IN ('fr', 'de')),
    s AS (SELECT source, (SELECT count(*) FROM l WHERE l.source = x.source) AS nl, (SELECT count(*) FROM r WHERE r.source = x.source) AS nr FROM (SELECT DISTINCT source FROM documents) x),
    g AS (SELECT source, nl, nr, greatest(nl, nr) AS n, unnest(range(0, greatest(nl, nr))) AS i FROM s WHERE nl > 0 AND nr > 0)
    SELECT g.source, g.i, l.v AS a, r.v AS b FROM g JOIN l ON l.source = g.source AND l.n = i * nl // g.n JOIN r ON r.source = g.source AND r.n = i * nr // g.n""",
)
def align_rows(t):
    from dossier.operators.ordered import row_index

    l, r = (row_index(d, ["source"], ["doc_id"], "n") for d in _sides(t))
    return M.align_rows(l, r, ["source"], "n", "v")


@query(
    "align_chunks",
    """WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS l, string_split(text, '. ') AS r FROM documents),
    g AS (SELECT doc_id, l, r, greatest(len(l), len(r)) AS n, unnest(range(0, greatest(len(l), len(r)))) AS i FROM c)
    SELECT doc_id, i, md5(l[i * len(l) // n + 1]) AS a, md5(r[i * len(r) // n + 1]) AS b FROM g""",
)
def align_chunks(t):
    pairs = M.align(F.split("text", "\n"), F.split("text", r"\. "))
    return unnest_structs(t.documents, ["doc_id"], pairs, ["i", "a", "b"]).select("doc_id", "i", F.md5("a").alias("a"), F.md5("b").alias("b"))


@query(
    "grounded_pairs",
    f"""WITH d AS (SELECT doc_id, {dclean('text')} AS c FROM documents),
    p AS (SELECT doc_id, (SELECT w FROM (SELECT unnest(string_split(c, ' ')) AS w, generate_subscripts(string_split(c, ' '), 1) AS i) WHERE i = doc_id % 5 + 1) AS zh, 'zz' || doc_id AS x, c FROM d),
    q AS (SELECT doc_id, zh, CASE WHEN doc_id % 3 = 0 THEN zh || 'QQ' ELSE translate(substr(c, 3, 4), 'aeinrst', 'AEINRST') END AS en, c FROM p)
    SELECT doc_id, {dstrip('zh')} AS zh, {dstrip('en')} AS en FROM q WHERE {dstrip('zh')} <> '' AND {dstrip('en')} <> '' AND contains(c, {dstrip('zh')}) AND contains(lower(c), lower({dstrip('en')}))""",
)
def grounded_pairs(t):
    d = t.documents.select("doc_id", F.col("text").alias("zh_text"), F.col("text").alias("en_text"))

    def pair(c):
        zh = F.try_element_at(F.split(c, " "), (F.col("doc_id") % 5 + 1).cast("int"))
        en = F.when(F.col("doc_id") % 3 == 0, F.concat(zh, F.lit("QQ"))).otherwise(F.translate(F.substring(c, 3, 4), "aeinrst", "AEINRST"))
        return F.array(F.struct(zh.alias("zh"), en.alias("en")))

    terms = unnest_structs(d, ["doc_id"], T.let(T.clean_markdown(F.col("zh_text")), pair), ["zh", "en"])
    return M.grounded_pairs(terms, d, "doc_id")


@query("positional_answers", "SELECT p_partkey, p_name AS keyword, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS aliases FROM part")
def positional_answers(t):
    """Answers by position: an answer list that is too short is padded with nothing."""
    ans = F.when(F.col("p_size") % 2 == 0, F.array(F.array("p_brand"), F.array("p_type"))).otherwise(F.array().cast("array<array<string>>"))
    rows = unnest_structs(t.part, ["p_partkey"], M.positional_answers(F.array("p_name"), ans), ["keyword", "aliases"])
    return rows.select("p_partkey", "keyword", F.array_join("aliases", ",").alias("aliases"))
