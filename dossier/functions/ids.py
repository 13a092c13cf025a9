"""Question ids and the item rules that look at one item at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import WS, let, lower_contains_any, strip

# Cell texts that are only column headers.
COLUMN_HEADERS = (
    "no", "no.", "item", "item no", "item no.", "question", "questions",
    "question / description", "description", "details", "competent authority response",
    "response", "answer", "remarks", "remarks / comments", "comments",
    "signature", "signature / date", "date", "official use only", "score",
)
# Openings of instructions and legal notices.
DISCLAIMERS = (
    rf"^(?:Please[{WS}]+complete[{WS}]+in[{WS}]+English|Please[{WS}]+use[{WS}]+block[{WS}]+capitals)\b",
    rf"^(?:This[{WS}]+questionnaire[{WS}]+is[{WS}]+established[{WS}]+under|In[{WS}]+accordance[{WS}]+with[{WS}]+Regulation[{WS}]+\()\b",
    rf"^(?:Note[{WS}]*:[{WS}]*(?:Please[{WS}]+fill|Answers[{WS}]+should|All[{WS}]+questions|Confidential))\b",
    rf"^(?:General[{WS}]+Instructions?|Guidance[{WS}]+Notes?)[{WS}]*:",
)
# Verbs that make a short line a question.
QUESTION_VERBS = (
    "please", "indicate", "provide", "describe", "specify", "state", "answer", "explain",
    "are", "is", "do", "does", "how", "what", "which",
)
# Phrases that announce a table.
TABLE_PROMPTS = (
    rf"table[{WS}]+below", rf"following[{WS}]+table", rf"in[{WS}]+the[{WS}]+table", rf"as[{WS}]+follows",
    rf"provide[{WS}]+details[{WS}]+in[{WS}]+table", rf"statistics[{WS}]+in[{WS}]+table", rf":[{WS}]*\z",
)
# Words that cannot be a section, and phrases that make a title a question.
NOT_A_SECTION = ("none", "null", "general", "n/a")
QUESTION_TITLES = ("please indicate", "please describe", "please provide", "are there", "is there", "do you have")
# Sub-item romans.
SUB_ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def normalize_question_id(c: Column) -> Column:
    """Canonical punctuation of one question id."""

    def named(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("_")), F.regexp_replace(x, r"(?i)\b(Part|Chapter|Section|Annex|Appendix)_([A-Za-z0-9]+)\b", "$1 $2")).otherwise(x)

    def stopped(x: Column) -> Column:
        # runs of underscores and stops are one stop, and white space around it goes
        return strip(F.btrim(F.regexp_replace(x, rf"[{WS}]*+[_.]+[{WS}]*+", "."), F.lit(". ")))

    def parted(x: Column) -> Column:
        found = F.contains(F.lower(x), F.lit("part")) & x.rlike(r"\d")
        return F.when(found, F.regexp_replace(x, rf"(?i)\b(Part[{WS}]+[A-Za-z0-9]+)[{WS}]+(\d+)\b", "$1.$2")).otherwise(x)

    return let(strip(c), lambda x: let(stopped(named(x)), parted))


def is_false_positive(qid: Column, text: Column) -> Column:
    """Column headers, instructions and blank bodies that are not questions."""
    known = F.struct(strip(F.coalesce(qid, F.lit(""))).alias("qid"), strip(F.coalesce(text, F.lit(""))).alias("text"))
    return let(known, lambda k: let(F.lower(strip(F.regexp_replace(k["text"], r"<[^>]+>", " "))), lambda bare: _false_positive(k["qid"], k["text"], bare)))


def _false_positive(qid: Column, text: Column, bare: Column) -> Column:
    plain = strip(F.regexp_replace(bare, rf"[{WS}.:_\-]+", " "))
    plain_id = F.lower(strip(F.regexp_replace(qid, rf"[{WS}.:_\-]+", " ")))
    return let(plain, lambda p: _no_question(qid, text, bare, p, plain_id))


def _no_question(qid: Column, text: Column, bare: Column, plain: Column, plain_id: Column) -> Column:
    header = plain.isin(*COLUMN_HEADERS)
    table, body = lower_contains_any(text, "<table"), lower_contains_any(text, "<table", "<ul")
    notice = F.lit(False)
    for pattern in DISCLAIMERS:
        notice = notice | bare.rlike("(?i)" + pattern)
    return (
        (qid == "")
        | (text == "")
        | (plain_id.isin(*COLUMN_HEADERS) & ((plain == "") | header))
        | (header & (F.length(plain) < 35) & ~body)
        | (notice & ~table & ~F.contains(text, F.lit("?")))
        | ((strip(F.regexp_replace(text, r"<[^>]+>", "")) == "") & ~body)
    )


def is_weak_heading(qid: Column, text: Column) -> Column:
    """A short noun phrase under a section-like id: a heading, not a question."""
    qid, text = strip(qid), strip(text)
    verbs = r"(?i)\b(?:" + "|".join(QUESTION_VERBS) + r")\b"
    return (
        ~text.rlike(r"(?i)<(?:table|ul|ol)\b")
        & ~F.contains(text, F.lit("?"))
        & ~text.rlike(verbs)
        & (F.length(text) < 60)
        & text.rlike(rf"^[A-Z][a-zA-Z0-9{WS}\-_/,&]+\z")
        & (qid.rlike(r"^(?:[A-Za-z0-9]+\.)+\d+\z") | qid.rlike(r"^[A-Za-z]\.\d+\z"))
    )


def expects_table(text: Column) -> Column:
    """The prompt announces a table or ends with a colon."""
    bare = F.lower(strip(F.regexp_replace(text, r"<[^>]+>", " ")))
    return bare.rlike("|".join(TABLE_PROMPTS))


def is_orphan_part(text: Column, previous: Column) -> Column:
    """A table or list that belongs to the item in front of it."""
    text = strip(text)
    has_part = text.rlike(r"(?i)<(?:table|ul|ol)\b")
    bare = strip(F.regexp_replace(text, r"<[^>]+>", ""))
    alone = (F.length(bare) < 5) & ~F.contains(strip(previous), F.lit("<table"))
    return F.coalesce(has_part & (expects_table(previous) | alone), F.lit(False))


def is_invalid_section(section: Column, title: Column) -> Column:
    """Outline entries that are question ids or questions, not sections."""
    asks = F.lit(False)
    for phrase in QUESTION_TITLES:
        asks = asks | F.contains(F.lower(title), F.lit(phrase))
    return (
        (section == "")
        | F.lower(section).isin(*NOT_A_SECTION)
        | section.rlike(r"(?i)\([a-z0-9]+\)")
        | section.rlike(r"^[A-Z]\.\d+\z")
        | (F.length(section) - F.length(F.regexp_replace(section, r"\.", "")) >= 2)
        | asks
        | F.endswith(strip(title), F.lit("?"))
    )


def sub_item_kind(raw: Column) -> Column:
    """'roman', 'alpha', 'digit' or 'root' for the label of an item; roman wins over alpha."""
    raw = strip(raw)
    core = F.lower(F.regexp_extract(raw, r"^\(?([A-Za-z]+|\d+)\)?\z", 1))
    return (
        F.when(core.isin(*SUB_ROMANS), "roman")
        .when(core.rlike(r"^[a-z]\z"), "alpha")
        .when(core.rlike(r"^\d+\z") & (F.length(raw) <= 3), "digit")
        .otherwise("root")
    )


def sub_item_core(raw: Column) -> Column:
    return F.lower(F.regexp_replace(strip(raw), r"[()]", ""))


def part_prefixed(qid: Column) -> Column:
    return qid.rlike(rf"(?i)^Part[{WS}]+[A-Za-z0-9]+")


def as_part_id(qid: Column) -> Column:
    """``b.3`` becomes ``Part B.3``; other ids stay."""
    letter = F.regexp_extract(qid, r"(?d)^([A-Za-z])\.(\d.*)$", 1)
    rest = F.regexp_extract(qid, r"(?d)^([A-Za-z])\.(\d.*)$", 2)
    return F.when(letter != "", F.concat(F.lit("Part "), F.upper(letter), F.lit("."), rest)).otherwise(qid)


def bounded_page(value: Column, total: Column) -> Column:
    """Page number from untrusted text: 1 when unreadable, clamped to 1..total."""
    return F.greatest(F.lit(1), F.least(F.coalesce(value.try_cast("int"), F.lit(1)), total))
