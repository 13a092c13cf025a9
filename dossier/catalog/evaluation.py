"""Scoring queries: labels are the expected answer, a length rule the prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import query
from dossier.operators import evaluate as E


def _sides(t):
    docs = t.documents.select("doc_id", F.col("source").alias("case_id"), "text", "n_chars")
    good = t.labels.where("quality = 1").join(docs, "doc_id")
    expected = good.select("case_id", F.col("doc_id").alias("question_id"), F.col("text").alias("question_text"), F.lit(0).alias("ord"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# *"), "text")).otherwise(F.concat("text", F.lit(" and more")))
    actual = docs.where("n_chars > 800").select("case_id", F.col("doc_id").alias("question_id"), body.alias("question_text"), F.lit(0).alias("ord"))
    return actual, expected


_SQL = """
WITH e AS (SELECT d.source AS case_id, d.doc_id AS question_id, text AS t FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1),
a AS (SELECT source AS case_id, doc_id AS question_id, CASE WHEN doc_id % 3 = 0 THEN '# *' || text ELSE text || ' and more' END AS t FROM documents WHERE n_chars > 800),
c AS (SELECT coalesce(a.case_id, e.case_id) AS case_id, coalesce(a.question_id, e.question_id) AS question_id,
  CASE WHEN a.question_id IS NULL THEN 'missing' WHEN e.question_id IS NULL THEN 'extra'
       WHEN regexp_replace(lower(a.t), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(e.t), '[^a-z0-9]+', '', 'g') THEN 'match' ELSE 'text_mismatch' END AS status
  FROM a FULL JOIN e ON a.case_id = e.case_id AND a.question_id = e.question_id),
s AS (SELECT case_id, count(*) FILTER (WHERE status <> 'extra') AS expected_count, count(*) FILTER (WHERE status <> 'missing') AS actual_count,
  count(*) FILTER (WHERE status IN ('match', 'text_mismatch')) AS true_positives, count(*) FILTER (WHERE status = 'text_mismatch') AS text_mismatches,
  count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'extra') AS extra FROM c GROUP BY case_id),
r AS (SELECT *, CASE WHEN actual_count = 0 THEN 0 ELSE true_positives / actual_count END AS p, CASE WHEN expected_count = 0 THEN 0 ELSE true_positives / expected_count END AS q FROM s)
"""


@query("eval_compare", _SQL + "SELECT case_id, question_id, status FROM c")
def eval_compare(t):
    return E.compared(*_sides(t))


@query(
    "eval_prf",
    _SQL + """SELECT case_id, expected_count, actual_count, true_positives, text_mismatches, missing, extra, round(p, 4) AS precision, round(q, 4) AS recall,
    round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 4) AS f1 FROM r""",
)
def eval_prf(t):
    s = E.scores(E.compared(*_sides(t)))
    return s.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


@query("eval_gate", _SQL + "SELECT case_id, round(q, 4) AS recall, CAST(q >= 0.8 AS INT) AS passed FROM r")
def eval_gate(t):
    g = E.gated(E.scores(E.compared(*_sides(t))), E.ENGINE_RECALL)
    return g.select("case_id", F.round("recall", 4).alias("recall"), F.col("passed").cast("int").alias("passed"))


@query("eval_summary", _SQL + "SELECT count(*) AS cases, sum(CAST(q >= 0.5 AS INT)) AS passed, CAST(bool_and(q >= 0.5) AS INT) AS all_passed FROM r")
def eval_summary(t):
    s = E.summary(E.scores(E.compared(*_sides(t))), 0.5)
    return s.select("cases", "passed", F.col("all_passed").cast("int").alias("all_passed"))


@query(
    "coverage_report",
    """WITH c AS (SELECT conv_id, turn AS source_key FROM conversations),
    s AS (SELECT conv_id, turn AS source_key FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn - 1 FROM conversations WHERE turn > 0 AND conv_id % 3 = 0)
    SELECT conv_id, source_key, 'missing' AS status FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id AND s.source_key = c.source_key)
    UNION ALL SELECT conv_id, source_key, 'duplicate' FROM s GROUP BY conv_id, source_key HAVING count(*) > 1""",
)
def coverage_report(t):
    c = t.conversations.select("conv_id", F.col("turn").alias("source_key"))
    s = t.conversations.where("role = 'assistant'").select("conv_id", F.col("turn").alias("source_key")).unionAll(
        t.conversations.where("turn > 0 AND conv_id % 3 = 0").select("conv_id", F.col("turn") - 1)
    )
    return E.key_coverage(c, s, ["conv_id"])


@query("id_sets", _SQL + "SELECT case_id, question_id FROM a INTERSECT SELECT case_id, question_id FROM e")
def id_sets(t):
    a, e = _sides(t)
    return a.select("case_id", "question_id").intersect(e.select("case_id", "question_id"))
