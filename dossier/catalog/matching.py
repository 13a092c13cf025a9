"""Dictionary and unit matching queries.

The dictionary holds the words of at least six letters of the benchmark passages, in
order of appearance; units are the nations with their regions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import query
from dossier.catalog.documents import dnorm
from dossier.functions.text import normalize_for_matching
from dossier.operators import match as M
from dossier.operators.retrieval import enriched_query
from dossier.operators.unnest import unnest


def _dictionary(t):
    words = unnest(t.benchmark, ["item_id"], F.regexp_extract_all("text", F.lit(r"[A-Za-z]{6,}"), F.lit(0)), "zh", "k")
    rows = words.select("zh", F.concat(F.lit("EN-"), F.col("zh")).alias("en"), (F.col("item_id") * 10000 + F.col("k")).alias("ord"))
    return M.load_dictionary(rows)


def _stems(t):
    d = _dictionary(t).where(F.length("zh") >= 9)
    return d.select(F.left("zh", F.lit(5)).alias("stem"), F.col("zh").alias("official"), "ord")


_SQL_DICT = """
WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS zh, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{6,}'), 1) - 1 AS k FROM benchmark),
dict AS (SELECT zh, 'EN-' || zh AS en, min(item_id * 10000 + k) AS ord FROM w GROUP BY zh)
"""


_SQL_PATTERNS = """, st AS (SELECT left(zh, 5) AS stem, arg_max(zh, ord) AS zh, min(ord) AS ord FROM dict WHERE len(zh) >= 9 GROUP BY 1),
p AS (SELECT ord AS pid, zh AS pattern, zh, en FROM dict
      UNION ALL SELECT ord + (SELECT max(ord) FROM dict) + 1, stem, zh, 'EN-' || zh FROM st WHERE stem NOT IN (SELECT zh FROM dict))"""


def dstandard(name: str, texts: str, key: str, text: str) -> str:
    """CTE ``name`` (key, pid, start): of all places of the patterns ``p``, those that a reading without overlaps takes.

    Every place follows the one before it in the text; in the order of their ends, then starts, a place counts that begins behind the last one counted.
    """
    return f""", {name}_at(k, pid, s) AS (SELECT {key}, pid, instr({text}, pattern) FROM {texts} JOIN p ON contains({text}, pattern)
      UNION ALL SELECT k, pid, s + instr(substr({text}, s + 1), pattern) FROM {name}_at JOIN {texts} ON {key} = k JOIN p USING (pid) WHERE instr(substr({text}, s + 1), pattern) > 0),
    {name}_all AS (SELECT k, list({{'stop': s - 1 + len(pattern), 'start': s - 1, 'taken': [{{'pid': pid, 'start': s - 1}}]}} ORDER BY s - 1 + len(pattern), s, pid) AS l FROM {name}_at JOIN p USING (pid) GROUP BY k),
    {name} AS (SELECT k AS {key}, o.pid AS pid, o.start AS start FROM (SELECT k, unnest(list_reduce(l, lambda a, e: CASE WHEN e.start >= a.stop
      THEN {{'stop': e.stop, 'start': e.start, 'taken': list_concat(a.taken, e.taken)}} ELSE a END).taken) AS o FROM {name}_all))"""


@query("load_dictionary", "SELECT p_name AS zh, arg_max(p_type, p_partkey) AS en, min(p_partkey) AS ord FROM part WHERE p_name <> '' AND p_size % 9 <> 0 GROUP BY 1")
def load_dictionary(t):
    return M.load_dictionary(t.part.select(F.col("p_name").alias("zh"), F.when(F.col("p_size") % 9 != 0, F.col("p_type")).alias("en"), F.col("p_partkey").alias("ord")))


@query("term_contains", _SQL_DICT + f", x AS (SELECT doc_id, {dnorm('text')} AS n FROM documents) SELECT doc_id, zh, en, ord AS pos FROM x JOIN dict ON contains(n, zh)")
def term_contains(t):
    texts = t.documents.select("doc_id", normalize_for_matching(F.col("text")).alias("n"))
    return M.term_hits(texts, ["doc_id"], "n", M.dictionary_patterns(_dictionary(t), _stems(t)), "contains").select("doc_id", "zh", "en", "pos")


@query(
    "term_standard",
    _SQL_DICT.replace("WITH", "WITH RECURSIVE", 1) + _SQL_PATTERNS + f", x AS (SELECT doc_id, {dnorm('text')} AS n FROM documents)" + dstandard("m", "x", "doc_id", "n")
    + " SELECT doc_id, zh, en, min(start) AS pos FROM m JOIN p USING (pid) GROUP BY 1, 2, 3",
)
def term_standard(t):
    """Non-overlapping matching with stems resolved to their official terms."""
    texts = t.documents.select("doc_id", normalize_for_matching(F.col("text")).alias("n"))
    return M.term_hits(texts, ["doc_id"], "n", M.dictionary_patterns(_dictionary(t), _stems(t)), "standard").select("doc_id", "zh", "en", "pos")


@query(
    "term_english",
    _SQL_DICT + """, v AS (SELECT zh, lower(zh) AS en, ord FROM dict) SELECT conv_id, turn, zh, ord AS pos FROM conversations JOIN v ON contains(lower(text), en)""",
)
def term_english(t):
    d = _dictionary(t).withColumn("en", F.upper("zh"))
    return M.english_hits(t.conversations, ["conv_id", "turn"], "text", M.dictionary_patterns(d)).select("conv_id", "turn", "zh", "pos")


_SQL_TOP = f""", x AS (SELECT doc_id, text, {dnorm('text')} AS n FROM documents),
h AS (SELECT doc_id, zh, en, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM x JOIN dict ON contains(n, zh)) """


@query(
    "term_enrich",
    _SQL_DICT + _SQL_TOP + """SELECT doc_id, md5(CASE WHEN s IS NULL THEN text ELSE '提問：' || text || ' 相關術語：' || s END) AS query_md5 FROM x
      LEFT JOIN (SELECT doc_id, string_agg(zh, '、' ORDER BY r) AS s FROM h WHERE r <= 5 GROUP BY 1) USING (doc_id)""",
)
def term_enrich(t):
    texts = t.documents.select("doc_id", "text", normalize_for_matching(F.col("text")).alias("n"))
    found = M.term_hits(texts, ["doc_id"], "n", M.dictionary_patterns(_dictionary(t)), "contains")
    # a text holds each dictionary term at most once here, so a group is bounded by the dictionary
    listed = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "zh"))), lambda x: x["zh"]).alias("terms"))
    rows = texts.join(listed, "doc_id", "left")
    return rows.select("doc_id", F.md5(enriched_query(F.col("text"), F.coalesce("terms", F.array().cast("array<string>")))).alias("query_md5"))


@query(
    "dictionary_xml",
    _SQL_DICT + _SQL_TOP + """SELECT doc_id, '<Mandatory_Dictionary>' || chr(10) || string_agg('  <term><zh>' || zh || '</zh><en>' || en || '</en></term>', chr(10) ORDER BY r) || chr(10) || '</Mandatory_Dictionary>' AS xml FROM h GROUP BY 1""",
)
def dictionary_xml(t):
    texts = t.documents.select("doc_id", normalize_for_matching(F.col("text")).alias("n"))
    found = M.term_hits(texts, ["doc_id"], "n", M.dictionary_patterns(_dictionary(t)), "contains")
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "zh", "en"))).alias("t"))
    return listed.select("doc_id", M.dictionary_xml(F.col("t")).alias("xml"))


@query(
    "term_grounded",
    _SQL_DICT + f""", x AS (SELECT doc_id, {dnorm('substr(text, 1, 200)')} AS q, {dnorm('substr(text, 201)')} AS c FROM documents)
    SELECT doc_id, zh, en, ord AS pos FROM x JOIN dict ON contains(c, zh) OR contains(q, zh)""",
)
def term_grounded(t):
    d = t.documents.select("doc_id", F.left("text", F.lit(200)).alias("q"), F.substr("text", F.lit(201)).alias("c"))
    return M.grounded_terms(d, ["doc_id"], "q", "c", M.dictionary_patterns(_dictionary(t), _stems(t)), "contains")


@query(
    "term_grounded_standard",
    _SQL_DICT.replace("WITH", "WITH RECURSIVE", 1) + _SQL_PATTERNS
    + f""", x AS (SELECT doc_id, q, c, CASE WHEN c <> '' THEN q || chr(10) || c ELSE q END AS n FROM (SELECT doc_id, {dnorm('substr(text, 1, 200)')} AS q, {dnorm('substr(text, 201)')} AS c FROM documents))"""
    + dstandard("m", "x", "doc_id", "n") + dstandard("b", "x", "doc_id", "c")
    + """ SELECT doc_id, zh, en, min(start) AS pos FROM m JOIN p USING (pid) JOIN x USING (doc_id)
      WHERE contains(q, zh) OR (doc_id, zh) IN (SELECT (doc_id, zh) FROM b JOIN p USING (pid)) GROUP BY 1, 2, 3""",
)
def term_grounded_standard(t):
    d = t.documents.select("doc_id", F.left("text", F.lit(200)).alias("q"), F.substr("text", F.lit(201)).alias("c"))
    return M.grounded_terms(d, ["doc_id"], "q", "c", M.dictionary_patterns(_dictionary(t), _stems(t)), "standard")


@query(
    "dictionary_patterns",
    _SQL_DICT + """, s AS (SELECT left(zh, 5) AS stem, arg_max(zh, ord) AS zh, min(ord) AS ord FROM dict WHERE len(zh) >= 9 GROUP BY 1)
    SELECT ord AS pid, zh AS pattern, zh, en, 0 AS is_stem FROM dict
    UNION ALL SELECT ord + (SELECT max(ord) FROM dict) + 1, stem, zh, 'EN-' || zh, 1 FROM s WHERE stem NOT IN (SELECT zh FROM dict)""",
)
def dictionary_patterns(t):
    p = M.dictionary_patterns(_dictionary(t), _stems(t))
    return p.select("pid", "pattern", "zh", "en", F.col("is_stem").cast("int").alias("is_stem"))


def _units(t):
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select(F.col("n_nationkey").alias("ord"), F.col("r_name").alias("agency"), F.col("n_name").alias("unit"),
                    F.concat("n_name", F.lit("、"), F.col("r_name")).alias("keywords"),
                    F.array(F.concat(F.lit("Kind "), F.col("n_name")), F.concat(F.lit("NATION "), (F.col("n_nationkey") + 30).cast("string"))).alias("extended"))


_SQL_UNITS = """
WITH u AS (SELECT n_nationkey AS ord, r_name AS agency, n_name AS unit FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT ord, agency, unit, 0 AS e, 0 AS i, unit AS w FROM u UNION ALL SELECT ord, agency, unit, 0, 1, agency FROM u
      UNION ALL SELECT ord, agency, unit, 1, 0, 'Kind ' || unit FROM u UNION ALL SELECT ord, agency, unit, 1, 1, 'NATION ' || (ord + 30) FROM u),
p AS (SELECT ord * 2097152 + e * 1048576 + i AS pid, agency, unit, e, regexp_replace(w, '[ _]', '', 'g') AS pattern FROM k WHERE w <> 'MIDDLE EAST'
      UNION ALL SELECT ord * 2097152 + e * 1048576 + i, agency, unit, e, 'MIDDLE' FROM k WHERE w = 'MIDDLE EAST' UNION ALL SELECT ord * 2097152 + e * 1048576 + i + 1, agency, unit, e, 'EAST' FROM k WHERE w = 'MIDDLE EAST')
"""


@query(
    "unit_profile",
    """WITH k AS (SELECT p_brand AS agency, p_type AS unit, p_partkey * 10 + i AS place, w FROM (
        SELECT p_partkey, p_brand, p_type, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
        UNION ALL SELECT p_brand, p_type, p_partkey * 10 + 9, 'size' || p_size FROM part WHERE p_size % 2 = 0)
    SELECT agency, unit, string_agg(w, '、' ORDER BY place) AS keywords FROM (SELECT agency, unit, w, min(place) AS place FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def unit_profile(t):
    ext = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("size"), F.col("p_size").cast("string"))))
    u = t.part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("agency"), F.col("p_type").alias("unit"), F.col("p_name").alias("keywords"), ext.alias("extended"))
    return M.unit_profile(u).select("agency", "unit", "keywords")


def _asked(t):
    """Customer names rewritten into questions that mention nations and regions."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lit("who in "), F.col("r_name"), F.lit(", or (kind) Kind NATION_"), (F.col("c_custkey") % 60).cast("string"), F.lit(" ?")).alias("q")
    )


_SQL_ASKED = """, a AS (SELECT c_custkey, regexp_replace('who in ' || r_name || ', or (kind) Kind NATION_' || (c_custkey % 60) || ' ?', '[ ,()_?]', '', 'g') AS q
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "intent_topn",
    _SQL_UNITS + _SQL_ASKED + """, m AS (SELECT c_custkey, agency, unit, pattern, pid, len(pattern) AS l FROM a JOIN p ON contains(q, pattern)),
    b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, agency, unit ORDER BY l DESC, pid) AS k FROM m)
    SELECT c_custkey, agency, unit, pattern AS keyword, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY l DESC, pid) AS rank FROM b WHERE k = 1) WHERE rank <= 3""",
)
def intent_topn(t):
    return M.classify(_asked(t), ["c_custkey"], "q", M.intent_patterns(_units(t)), 3, "contains")


@query(
    "intent_standard",
    _SQL_UNITS.replace("WITH", "WITH RECURSIVE", 1) + _SQL_ASKED + dstandard("g", "a", "c_custkey", "q")
    + """, m AS (SELECT c_custkey, agency, unit, pattern, pid, len(pattern) AS l FROM g JOIN p USING (pid)),
    b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, agency, unit ORDER BY l DESC, pid) AS k FROM m)
    SELECT c_custkey, agency, unit, pattern AS keyword, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY l DESC, pid) AS rank FROM b WHERE k = 1) WHERE rank <= 3""",
)
def intent_standard(t):
    return M.classify(_asked(t), ["c_custkey"], "q", M.intent_patterns(_units(t)), 3, "standard")


@query(
    "alias_lookup",
    _SQL_UNITS + """, own AS (SELECT pattern, arg_max(struct_pack(a := agency, u := unit), pid) AS o, min(pid) AS p1 FROM p WHERE e = 0 GROUP BY 1),
    ext AS (SELECT pattern, arg_min(struct_pack(a := agency, u := unit), pid) AS o, min(pid) AS p2 FROM p WHERE e = 1 GROUP BY 1),
    owner AS (SELECT coalesce(own.pattern, ext.pattern) AS pattern, coalesce(own.o, ext.o) AS o, least(p1, p2) AS ord FROM own FULL JOIN ext ON own.pattern = ext.pattern),
    al AS (SELECT s_suppkey AS ord, CASE s_suppkey % 4 WHEN 0 THEN 'NATION' || (s_suppkey % 60) WHEN 1 THEN 'xxNATION' || (s_suppkey % 60) || 'yy' WHEN 2 THEN 'nothing' ELSE 'TION' || (s_suppkey % 30) END AS std,
           CASE WHEN s_suppkey % 10 = 0 THEN 'NATION1' ELSE regexp_replace(s_name, '[#_ ]', '', 'g') END AS alias FROM supplier),
    f AS (SELECT al.ord, alias, coalesce((SELECT o FROM owner WHERE owner.pattern = std), (SELECT o FROM owner WHERE contains(owner.pattern, std) OR contains(std, owner.pattern) ORDER BY owner.ord LIMIT 1)) AS o FROM al)
    SELECT ord + 2305843009213693952 AS pid, alias AS pattern, o.a AS agency, o.u AS unit FROM f WHERE o IS NOT NULL AND alias NOT IN (SELECT pattern FROM owner)
    UNION ALL SELECT pid, pattern, agency, unit FROM p""",
)
def alias_lookup(t):
    k = F.col("s_suppkey")
    std = (
        F.when(k % 4 == 0, F.concat(F.lit("NATION_"), (k % 60).cast("string"))).when(k % 4 == 1, F.concat(F.lit("xx NATION_"), (k % 60).cast("string"), F.lit("yy")))
        .when(k % 4 == 2, F.lit("nothing")).otherwise(F.concat(F.lit("TION"), (k % 30).cast("string")))
    )
    aliases = t.supplier.select(std.alias("standard"), F.when(k % 10 == 0, F.lit("NATION 1")).otherwise(F.col("s_name")).alias("alias"), k.alias("ord"))
    return M.intent_patterns(_units(t), aliases)
