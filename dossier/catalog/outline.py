"""Outline queries: conversations are documents, turns are pages; events are long groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.catalog import query
from dossier.operators import ordered as O
from dossier.operators import outline as L
from dossier.params import VERIFY_BATCH


def _pages(t):
    return t.conversations.select("conv_id", (F.col("turn") + 1).cast("int").alias("page"))


def _entries(t):
    total = t.conversations.groupBy("conv_id").agg(F.count("*").cast("int").alias("total_pages"))
    page = F.when(F.col("turn") % 4 == 3, "x").otherwise(((F.col("turn") * 7 + F.col("conv_id")) % 9).cast("string"))
    return t.conversations.select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("id"),
                       F.col("role").alias("title"), page.alias("page")).join(total, "conv_id")


_SQL = """
WITH tot AS (SELECT conv_id, count(*) AS total_pages FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, turn AS ord, 'S' || turn AS id, role AS title,
      greatest(1, least(coalesce(try_cast(CASE WHEN turn % 4 = 3 THEN 'x' ELSE CAST((turn * 7 + conv_id) % 9 AS VARCHAR) END AS INT), 1), total_pages)) AS start_page, total_pages
      FROM conversations JOIN tot USING (conv_id)),
anchors AS (SELECT conv_id, ord, id, title, start_page, coalesce(greatest(start_page, lead(start_page) OVER (PARTITION BY conv_id ORDER BY start_page, ord) - 1), total_pages) AS end_page, total_pages FROM e),
pages AS (SELECT conv_id, turn + 1 AS page FROM conversations)
"""


@query("toc_anchors", _SQL + "SELECT conv_id, ord, id, title, start_page, end_page, total_pages FROM anchors")
def toc_anchors(t):
    return L.toc_anchors(_entries(t), "conv_id").select("conv_id", "ord", "id", "title", "start_page", "end_page", "total_pages")


@query(
    "active_anchor",
    _SQL + """SELECT conv_id, page, coalesce((SELECT id FROM anchors a WHERE a.conv_id = p.conv_id AND p.page BETWEEN start_page AND end_page ORDER BY start_page, ord LIMIT 1),
      (SELECT id FROM anchors a WHERE a.conv_id = p.conv_id ORDER BY start_page DESC, ord DESC LIMIT 1)) AS id FROM pages p""",
)
def active_anchor(t):
    anchors = L.toc_anchors(_entries(t), "conv_id")
    return L.active_anchor(_pages(t), anchors, "conv_id").select("conv_id", "page", "id")


@query(
    "page_paths",
    _SQL + """SELECT conv_id, page, coalesce((SELECT id FROM e WHERE e.conv_id = p.conv_id AND start_page <= p.page ORDER BY start_page DESC, ord DESC LIMIT 1),
      (SELECT id FROM e WHERE e.conv_id = p.conv_id ORDER BY start_page, ord LIMIT 1)) AS path FROM pages p""",
)
def page_paths(t):
    nodes = L.toc_anchors(_entries(t), "conv_id").select("conv_id", "ord", F.col("start_page").alias("page"), F.col("id").alias("path"))
    return L.page_paths(_pages(t), nodes, "conv_id").select("conv_id", "page", "path")


@query(
    "asof_ancestor",
    """WITH n AS (SELECT conv_id, turn AS ord, (turn * 120 + (conv_id * turn * 37) % 300) AS pos, 'P' || turn AS path, role AS title FROM conversations WHERE role = 'user' AND conv_id % 5 <> 0),
    r AS (SELECT *, max(pos) OVER (PARTITION BY conv_id ORDER BY ord) AS reach FROM n),
    c AS (SELECT conv_id, turn AS chunk_idx, turn * 150 AS start, 'H' || turn AS heading FROM conversations)
    SELECT conv_id, chunk_idx, CASE WHEN conv_id IN (SELECT conv_id FROM n) THEN coalesce((SELECT path FROM r WHERE r.conv_id = c.conv_id AND reach <= c.start ORDER BY ord DESC LIMIT 1),
        (SELECT path FROM r WHERE r.conv_id = c.conv_id ORDER BY ord LIMIT 1)) ELSE coalesce((SELECT heading FROM c p WHERE p.conv_id = c.conv_id AND p.chunk_idx = c.chunk_idx - 1), '') END AS path FROM c""",
)
def asof_ancestor(t):
    pos = F.col("turn") * 120 + (F.col("conv_id") * F.col("turn") * 37) % 300
    tag = lambda p: F.concat(F.lit(p), F.col("turn").cast("string"))
    nodes = t.conversations.where("role = 'user' AND conv_id % 5 <> 0").select("conv_id", F.col("turn").alias("ord"), pos.alias("pos"), tag("P").alias("path"), F.col("role").alias("title"))
    chunks = t.conversations.select("conv_id", F.col("turn").alias("chunk_idx"), (F.col("turn") * 150).alias("start"), tag("H").alias("heading"))
    return L.chunk_paths(chunks, nodes, "conv_id").select("conv_id", "chunk_idx", "path")


@query(
    "forward_fill_section",
    """SELECT event_id, user_id, round(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS section,
       lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next_type FROM events""",
)
def forward_fill_section(t):
    """Carried, previous and next values inside long groups, cut into blocks of event ids."""
    e = t.events.select("event_id", "user_id", "event_type", "value")
    e = O.carry_forward(e, ["user_id"], ["event_id"], {"section": F.when(F.col("event_type") == "signup", F.col("value"))})
    e = O.previous(e, ["user_id"], ["event_id"], {"previous_type": F.col("event_type")})
    e = O.following(e, ["user_id"], ["event_id"], {"next_type": F.col("event_type")})
    return e.select("event_id", "user_id", F.round("section", 6).alias("section"), "previous_type", "next_type")


@query(
    "filled_pages",
    _SQL + """, m AS (SELECT conv_id, start_page AS page, ord, id FROM e WHERE conv_id % 2 = 0 OR ord > 1),
    own AS (SELECT conv_id, page, ord, id AS section_id, 'top' AS position, 1 AS is_major FROM m)
    SELECT conv_id, page, ord, section_id, position, is_major FROM own
    UNION ALL SELECT conv_id, page, 0, (SELECT id FROM m WHERE m.conv_id = p.conv_id AND m.page < p.page ORDER BY m.page DESC, ord DESC LIMIT 1) AS s, 'full_page', 0 FROM pages p
    WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.conv_id = p.conv_id AND m.page = p.page) AND EXISTS (SELECT 1 FROM m WHERE m.conv_id = p.conv_id AND m.page < p.page)""",
)
def filled_pages(t):
    a = L.toc_anchors(_entries(t), "conv_id").where("conv_id % 2 = 0 OR ord > 1")
    entries = a.select("conv_id", F.col("start_page").alias("page"), "ord", F.col("id").alias("section_id"), F.col("id").alias("subsection_id"), "title",
                       F.lit("top").alias("position"), F.lit(True).alias("is_major"), F.lit("").alias("depiction"))
    out = L.filled_pages(_pages(t), entries, "conv_id")
    return out.select("conv_id", "page", "ord", "section_id", "position", F.col("is_major").cast("int").alias("is_major"))


_POS = "CASE turn % 4 WHEN 0 THEN 'bottom' WHEN 1 THEN 'top' WHEN 2 THEN 'middle' ELSE 'other' END"
_RANK = "CASE turn % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END"


def _placed(t):
    pos = F.element_at(F.array(*[F.lit(p) for p in ("bottom", "top", "middle", "other")]), (F.col("turn") % 4 + 1).cast("int"))
    page = ((F.col("turn") * 5 + F.col("conv_id")) % 7 + 1).alias("page")
    return t.conversations.select("conv_id", "turn", F.concat(F.col("role"), (F.col("turn") % 5).cast("string")).alias("section_id"), page, pos.alias("position"))


@query(
    "section_reorder",
    f"""WITH s AS (SELECT conv_id, turn, role || (turn % 5) AS section_id, (turn * 5 + conv_id) % 7 + 1 AS page, {_RANK} AS r FROM conversations),
    k AS (SELECT conv_id, section_id, min(ord) AS ord FROM (SELECT conv_id, role || (turn % 5) AS section_id, turn AS ord FROM conversations UNION ALL SELECT conv_id, 'extra' || turn, turn FROM conversations WHERE turn < 2) GROUP BY 1, 2),
    c AS (SELECT conv_id, section_id, min(page * 10 + r) AS pt FROM s GROUP BY 1, 2),
    l AS (SELECT conv_id, max(page) AS last FROM s GROUP BY 1)
    SELECT conv_id, section_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(pt, (coalesce(last, 1) + 1) * 10), CASE WHEN pt IS NULL THEN ord ELSE 0 END, ord, section_id) AS place
    FROM k LEFT JOIN c USING (conv_id, section_id) LEFT JOIN l USING (conv_id)""",
)
def section_reorder(t):
    placed = _placed(t)
    extra = t.conversations.where("turn < 2").select("conv_id", F.concat(F.lit("extra"), F.col("turn").cast("string")).alias("section_id"), F.col("turn").alias("ord"))
    known = placed.select("conv_id", "section_id", F.col("turn").alias("ord")).unionByName(extra)
    return L.reordered_sections(placed.where("turn <= 3"), placed.where("turn > 3"), known, "conv_id")


@query(
    "section_order",
    f"""WITH s AS (SELECT conv_id, turn, role || (turn % 5) AS section_id, (turn * 5 + conv_id) % 7 + 1 AS page, {_RANK} AS r, CASE WHEN turn % 2 = 1 THEN text ELSE '' END AS d FROM conversations WHERE role <> 'system')
    SELECT conv_id, section_id, row_number() OVER (PARTITION BY conv_id ORDER BY pt) AS place, d AS depiction FROM (
      SELECT conv_id, section_id, min(page * 1000000 + r * 100000 + turn) AS pt, coalesce(arg_min(d, page * 1000000 + r * 100000 + turn) FILTER (WHERE d <> ''), '') AS d FROM s GROUP BY 1, 2)""",
)
def section_order(t):
    entries = _placed(t).join(t.conversations.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"])
    entries = entries.withColumns({"depiction": F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise(""), "invalid": F.col("role") == "system", "ord": F.col("turn")})
    return L.section_order(entries, "conv_id")


@query(
    "section_first_appearance",
    """SELECT conv_id, section_id, pt // 1000 AS page, pt % 1000 AS idx FROM (SELECT conv_id, role || (turn % 5) AS section_id, min(((turn * 5 + conv_id) % 7 + 1) * 1000 + turn) AS pt FROM conversations GROUP BY 1, 2)""",
)
def section_first_appearance(t):
    return L.first_appearance(_placed(t).withColumnRenamed("turn", "idx"), "conv_id")


@query(
    "anchor_calibration",
    _SQL + """, f AS (SELECT conv_id, lower(id) AS k, max(page) AS page FROM (
        SELECT conv_id, 's' || turn AS id, (turn + conv_id) % 6 + 1 AS page FROM conversations WHERE role = 'assistant' OR turn % 3 = 0) GROUP BY 1, 2),
    moved AS (SELECT e.conv_id, e.ord, e.id, coalesce(f.page, start_page) AS start_page, total_pages, CAST(coalesce(f.page <> start_page, FALSE) AS INT) AS is_calibrated FROM e LEFT JOIN f ON f.conv_id = e.conv_id AND f.k = lower(e.id)
      UNION ALL SELECT f.conv_id, t.top + f.page, f.k, f.page, t.total_pages, 1 FROM f JOIN (SELECT conv_id, max(ord) AS top, max(total_pages) AS total_pages FROM e GROUP BY 1) t ON t.conv_id = f.conv_id
        WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = f.conv_id AND lower(e.id) = f.k))
    SELECT conv_id, id, start_page, is_calibrated, coalesce(greatest(start_page, lead(start_page) OVER (PARTITION BY conv_id ORDER BY start_page, ord, id) - 1), total_pages) AS end_page FROM moved""",
)
def anchor_calibration(t):
    found = t.conversations.where("role = 'assistant' OR turn % 3 = 0").select(
        "conv_id", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("id"), F.lit("").alias("title"), ((F.col("turn") + F.col("conv_id")) % 6 + 1).cast("int").alias("page")
    )
    out = L.calibrated(L.toc_anchors(_entries(t), "conv_id"), found, "conv_id")
    return out.select("conv_id", "id", "start_page", F.col("is_calibrated").cast("int").alias("is_calibrated"), "end_page")


@query(
    "transition_split",
    """WITH q AS (SELECT user_id, event_id, event_type FROM events), f AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS t FROM q GROUP BY 1)
    SELECT event_id, user_id, CAST(event_id >= t AS INT) AS after FROM q JOIN f USING (user_id)""",
)
def transition_split(t):
    out = L.after_transition(t.events, F.col("event_type") == "purchase", ["user_id"], "event_id")
    return out.select("event_id", "user_id", F.col("after").cast("int").alias("after"))


@query("verification_batches", f"SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // {VERIFY_BATCH} AS batch FROM events")
def verification_batches(t):
    return L.verification_batches(t.events.select("event_id", "user_id"), ["user_id"], ["event_id"], VERIFY_BATCH)
