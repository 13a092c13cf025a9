"""Reading JSON that a model wrote: fences, cut-off arrays, wrong shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import WS, let, strip

_ROWS = "array<map<string,string>>"
_ROW = "map<string,string>"


def strip_fence(c: Column) -> Column:
    """Take off a Markdown code fence."""
    out = F.regexp_replace(strip(c), rf"(?i)^```(?:json)?[{WS}]*", "")
    return strip(F.regexp_replace(strip(out), rf"[{WS}]*```\z", ""))


def _parse(text: Column) -> Column:
    """Objects of a JSON array, or of a single object; null unless the whole text is valid."""

    def read(c: Column) -> Column:
        rows = F.from_json(c, _ROWS, {"mode": "PERMISSIVE"})
        # the JSON functions stop reading at the end of the first value, so trailing text is
        # caught by asking for exactly one value inside brackets of our own
        whole = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
        return (
            F.when(c.startswith("[") & c.endswith("]") & whole, F.filter(F.coalesce(rows, _objects(c)), lambda r: r.isNotNull()))
            .when(c.startswith("{") & c.endswith("}") & whole, F.array(F.from_json(c, _ROW, {"mode": "PERMISSIVE"})))
        )

    return let(strip(text), read)


def _objects(c: Column) -> Column:
    """Flat objects found anywhere in the text."""
    found = F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), F.lit(0))
    parsed = F.transform(found, lambda o: F.when(F.json_object_keys(o).isNotNull(), F.from_json(o, _ROW)))
    return F.filter(parsed, lambda o: o.isNotNull())


def _truthy(row: Column, *keys: str) -> Column:
    hit = F.lit(False)
    for k in keys:
        value = F.try_element_at(row, F.lit(k))
        hit = hit | (value.isNotNull() & ~value.isin("", "0", "false", "null"))
    return hit


def none_rows() -> Column:
    return F.array().cast(_ROWS)


def repair_array(c: Column) -> Column:
    """``array<map<string,string>>`` of a possibly cut-off JSON array.

    The whole text, else the text up to the last closed object, else every flat object
    that carries a section id, an id or a title.
    """

    def read(raw: Column) -> Column:
        first = F.instr(raw, "[")
        last = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
        closed = F.concat(F.substr(raw, first, last - first + 1), F.lit("]"))
        usable = (first > 0) & F.contains(raw, F.lit("}")) & (last > first)
        return F.coalesce(
            _parse(raw),
            F.when(usable, _parse(closed)),
            F.filter(_objects(raw), lambda r: _truthy(r, "section_id", "id", "title")),
            none_rows(),
        )

    return let(strip_fence(c), read)


def parse_array(c: Column, greedy: bool = True) -> Column:
    """Whole text, else the first bracketed part, else the fenced part, else empty."""

    def read(x: Column) -> Column:
        bracket = F.regexp_extract(x, r"(?s)\[.*\]" if greedy else r"(?s)\[.*?\]", 0)
        fence = F.regexp_extract(x, rf"(?is)```(?:json)?[{WS}]*(.*?)```", 1)
        return F.coalesce(_parse(x), _parse(bracket), _parse(fence), none_rows())

    return let(strip(c), read)


def parse_term_pairs(c: Column) -> Column:
    """``array<struct<zh,en,unit>>`` of a term-mining answer; both terms must be non-blank."""
    get = lambda r, k: strip(F.coalesce(F.try_element_at(r, F.lit(k)), F.lit("")))
    rows = F.transform(
        parse_array(c, greedy=False),
        lambda r: F.struct(
            get(r, "chinese_term").alias("zh"), get(r, "english_term").alias("en"), get(r, "responsible_unit").alias("unit")
        ),
    )
    return F.filter(rows, lambda r: (r["zh"] != "") & (r["en"] != ""))


def parse_units(c: Column, top_n: int) -> Column:
    """``array<struct<agency,unit,reason>>`` from the tagged result of the routing model."""
    tagged = strip(F.regexp_extract(c, r"(?s)<JSON_Result>(.*?)</JSON_Result>", 1))
    body = F.when(c.rlike(r"(?s)<JSON_Result>.*?</JSON_Result>"), tagged).otherwise(c)
    listed = F.regexp_extract(body, rf"(?s)\[[{WS}]*\{{.*\}}[{WS}]*\]", 0)
    single = F.regexp_extract(body, r"\{[^{}]*\}", 0)
    rows = F.when(listed != "", _parse(listed)).otherwise(_parse(single))
    get = lambda r, k: strip(F.coalesce(F.try_element_at(r, F.lit(k)), F.lit("")))
    units = F.transform(
        F.coalesce(rows, none_rows()),
        lambda r: F.struct(get(r, "機關").alias("agency"), get(r, "單位").alias("unit"), get(r, "理由").alias("reason")),
    )
    named = F.filter(units, lambda u: (u["agency"] != "") | (u["unit"] != ""))
    # the first of each pair stays
    first = F.filter(
        F.transform(named, lambda u, i: F.struct(u.alias("u"), i.alias("i"))),
        lambda x: ~F.exists(F.slice(named, 1, x["i"]), lambda v: (v["agency"] == x["u"]["agency"]) & (v["unit"] == x["u"]["unit"])),
    )
    return F.slice(F.transform(first, lambda x: x["u"]), 1, top_n)


def _rows_and_size(c: Column) -> Column:
    """Struct(rows, n): objects of an answer that is a JSON array, and its number of entries."""
    return let(
        strip_fence(c),
        lambda raw: F.struct(F.when(raw.startswith("["), _parse(raw)).alias("rows"), F.json_array_length(raw).alias("n")),
    )


# Source kinds a model may return in place of a role.
ROLE_OF_KIND = {
    "parent_requirement": "continuation",
    "parent_heading": "question",
    "letter_item": "question",
    "inline_subitem": "question",
    "explicit_item": "question",
    "implicit_list_item": "question",
}
ROLES = ("question", "continuation", "exclude")


def keyed_items(c: Column) -> Column:
    """Struct(items, error) of a v1 answer: id or source key, text, role.

    A wrong shape makes the whole answer an error, as the caller drops the segment then.
    """
    get = lambda r, k: strip(F.coalesce(F.try_element_at(r, F.lit(k)), F.lit("")))
    has = lambda r, k: F.map_contains_key(r, k)

    def role(r: Column) -> Column:
        given = F.lower(strip(F.coalesce(F.try_element_at(r, F.lit("role")), F.lit("question"))))
        out = F.when(F.lit(False), given)
        for kind, known in ROLE_OF_KIND.items():
            out = out.when(given == kind, known)
        return out.otherwise(given)

    def check(x: Column) -> Column:
        rows = x["rows"]
        bad_keys = F.exists(rows, lambda r: ~has(r, "question_text") | ~(has(r, "source_key") | has(r, "question_id")))
        bad_role = F.exists(rows, lambda r: ~role(r).isin(*ROLES))
        error = (
            F.when(rows.isNull() | (F.size(rows) != x["n"]), "answer is not a JSON array of objects")
            .when(bad_keys, "item without question_text or key")
            .when(bad_role, "unknown role")
        )
        items = F.transform(
            rows,
            lambda r: F.struct(
                get(r, "question_id").alias("question_id"), get(r, "question_text").alias("question_text"),
                get(r, "source_key").alias("source_key"), role(r).alias("role"),
            ),
        )
        return F.struct(F.when(error.isNull(), items).alias("items"), error.alias("error"))

    return let(_rows_and_size(c), check)


def plain_items(c: Column, strict: bool) -> Column:
    """Struct(items, error) of a v2 (``strict``) or page answer: id and text.

    Blank items are dropped. ``strict`` turns a wrong shape into an error, else bad items are skipped.
    """
    get = lambda r, k: strip(F.coalesce(F.try_element_at(r, F.lit(k)), F.lit("")))
    has = lambda r, k: F.map_contains_key(r, k)

    def check(x: Column) -> Column:
        rows = x["rows"]
        error = F.when(rows.isNull(), "answer is not a JSON array")
        if strict:
            bad = (F.size(rows) != x["n"]) | F.exists(rows, lambda r: ~has(r, "question_id") | ~has(r, "question_text"))
            error = error.when(bad, "item without question_id or question_text")
        items = F.transform(rows, lambda r: F.struct(get(r, "question_id").alias("question_id"), get(r, "question_text").alias("question_text")))
        kept = F.filter(items, lambda i: (i["question_id"] != "") & (i["question_text"] != ""))
        return F.struct(F.when(error.isNull(), kept).alias("items"), error.alias("error"))

    return let(_rows_and_size(c), check)
