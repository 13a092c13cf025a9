"""Text cleaning and predicates as Column expressions (no Python in the data path)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() and Unicode-aware \s treat as white space,
# written as the body of a character class that Java and RE2 both accept.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The same characters as they are, for trims without a pattern.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# A run of them as Java reads it fastest: one range turns away all other ASCII characters before the class is asked.
WS_RUN = rf"(?![!-~])[{WS}]+"
# Line ends recognised when a text is cut into lines.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# Characters removed before keyword matching.
MATCH_DROP = (
    WS
    + r"，。、；：！？（）「」『』【】‘’“”《》〈〉"
    + r".,;:!?()\[\]{}\\/\-_@#$%\^&*+=|<>~`'" + '"'
    + r"\x{200B}-\x{200F}\x{FEFF}"
)
# Control characters a database text column refuses.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Separators between keywords in one cell.
KEYWORD_SPLIT = r"[,;，；、" + WS + r"]+"
# Separators between responsible units in one cell.
UNIT_SPLIT = r"[、,/;" + WS + r"]+"
# Suffixes cut once from the end of an official term.
STEM_SUFFIXES = (
    "及其製品", "及製品", "及其加工品", "加工品", "加工食品", "加工製品",
    "相關製品", "衍生物", "衍生品", "容許量", "標準值", "限量",
    "檢驗基準", "作業準則", "管理辦法", "處理規範", "其他", "等", "類",
)
# Stems too general to keep.
STEM_STOPWORDS = (
    "食品", "產品", "商品", "物品", "貨品", "貨物", "標準", "規定", "規範", "要求", "限制", "辦法",
    "申請", "許可", "認證", "登記", "檢驗", "檢查", "進口", "出口", "輸入", "輸出",
    "管理", "業者", "廠商", "機關", "單位",
)
# Aliases too general to keep.
ALIAS_STOPWORDS = (
    "主管機關", "有關單位", "相關機關", "相關單位", "政府機關", "主管單位", "行政機關",
    "中央主管", "地方主管", "主管部門", "政府部門", "機關", "單位", "部門", "機構",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row however often the body uses it.

    A column expression used several times is otherwise evaluated once per use wherever
    common subexpressions are not shared, as in conditions and lambda functions.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Both-sided trim of every Unicode white space (Spark's trim only takes U+0020)."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, WS_RUN, " "))


def lines(c: Column) -> Column:
    """Lines of a text; a final line end does not open another line."""
    return let(
        F.split(c, LINE_END),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def lower_contains_any(c: Column, *needles: str) -> Column:
    """True when any of the lower-case needles occurs in the lower-cased text."""
    low = F.lower(c)
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(low, F.lit(n))
    return found


def normalize_for_matching(c: Column) -> Column:
    """Delete white space, CJK and ASCII punctuation and zero-width characters."""
    # letters and digits of ASCII are turned away by three ranges, before the long class is asked
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?![a-zA-Z0-9])[{MATCH_DROP}]+", "")


def sanitize_for_storage(c: Column) -> Column:
    """Drop control characters (tab and line ends stay), then trim."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, ""))


def clean_markdown(c: Column) -> Column:
    """Plain text of a Markdown source, one space between words.

    The link rule runs before the image rule and inline code loses its content;
    both are visible behaviour and kept.
    """
    steps = (
        (rf"(?md)^#{{1,6}}[{WS}]*", ""),
        (r"[*_]", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"<[^>]+>", ""),
        (rf"(?md)^\|[{WS}\-:|]+\|.*$", ""),
        (r"`[^`]*`", ""),
        (r"\|", " "),
        (r"[\p{Cf}\x{A0}]", ""),
    )
    out = F.coalesce(c, F.lit(""))
    for pattern, repl in steps:
        out = F.regexp_replace(out, pattern, repl)
    return collapse(out)


def is_chinese(c: Column) -> Column:
    """CJK ideographs make up strictly more than 30% of all characters."""
    return F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}]", "")) > F.lit(0.3) * F.length(c)


def has_english(c: Column) -> Column:
    """At least three ASCII letters."""
    return c.rlike(r"[A-Za-z](?:[^A-Za-z]*+[A-Za-z]){2}")


def contains_latin(c: Column) -> Column:
    return c.rlike(r"[A-Za-z]")


def contains_non_latin(c: Column) -> Column:
    """Any letter outside ASCII."""
    return c.rlike(r"[\p{L}&&[^\x00-\x7F]]")


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only; used when texts are compared."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def split_keywords(c: Column) -> Column:
    return F.filter(F.split(strip(c), KEYWORD_SPLIT), lambda k: k != "")


def split_units(c: Column) -> Column:
    return F.filter(F.split(c, UNIT_SPLIT), lambda k: k != "")


def tokens_bytes4(c: Column) -> Column:
    """UTF-8 bytes divided by four."""
    return F.floor(F.octet_length(c) / 4).cast("long")


def tokens_chars2(c: Column) -> Column:
    """Characters divided by two."""
    return F.floor(F.length(c) / 2).cast("long")


def tokens_bpe(c: Column, encoding: str = "cl100k_base") -> Column:
    """Byte-pair token count; needs the tiktoken vocabulary on the workers."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        enc = tiktoken.get_encoding(encoding)
        return texts.fillna("").map(lambda t: len(enc.encode(t)) if t else 0)

    return count(c)


def trim_suffix(c: Column) -> Column:
    """Cut one known suffix from the end of an official term."""
    return F.regexp_replace(c, "(" + "|".join(STEM_SUFFIXES) + r")\z", "")


def valid_stem(original: Column, stem: Column) -> Column:
    return (F.length(stem) >= 2) & F.contains(original, stem) & ~stem.isin(*STEM_STOPWORDS)


def valid_alias_shape(alias: Column) -> Column:
    """Length and stop-word part of the alias test; known keywords go by anti join."""
    a = strip(alias)
    return (F.length(a) >= 2) & ~a.isin(*ALIAS_STOPWORDS)


def answer_halves(c: Column) -> Column:
    """Struct(english, chinese) of a two-part answer.

    First a line of three or more dashes, then the first ``---`` anywhere, else both equal.
    """
    by_line = F.split(c, r"\n-{3,}\n", 2)
    by_dash = F.split(c, "---", 2)
    parts = F.when(F.size(by_line) == 2, by_line).when(F.size(by_dash) == 2, by_dash).otherwise(F.array(c, c))
    return F.struct(
        strip(F.element_at(parts, 1)).alias("english"), strip(F.element_at(parts, 2)).alias("chinese")
    )


def nfkc(c: Column) -> Column:
    """NFKC of the visible text of a Markdown document.

    Link targets, tags and fenced code keep their bytes. ASCII-only rows never reach Python.
    """
    @F.pandas_udf("string")
    def visible(texts: pd.Series) -> pd.Series:
        import re
        from unicodedata import normalize

        kept = re.compile(r"\]\([^)]+\)|<[^>]+>")

        def one_line(line: str) -> str:
            out, at = [], 0
            for m in kept.finditer(line):
                out += [normalize("NFKC", line[at:m.start()]), m.group()]
                at = m.end()
            return "".join(out) + normalize("NFKC", line[at:])

        def one(text: str | None) -> str | None:
            if text is None or text.isascii():
                return text
            fenced, out = False, []
            for line in text.splitlines(keepends=True):
                mark = line.lstrip().startswith("```")
                out.append(line if mark or fenced else one_line(line))
                fenced ^= mark
            return "".join(out)

        return texts.map(one)

    return F.when(c.rlike(r"[^\x00-\x7F]"), visible(c)).otherwise(c)


def to_traditional(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Simplified to Traditional Chinese.

    With a character ``mapping`` the replacement is a JVM ``translate``; without one the
    OpenCC tables are used, and it is an error if they are not installed.
    """
    if mapping:
        keys = "".join(mapping)
        return F.translate(c, keys, "".join(mapping[k] for k in keys))
    import opencc  # noqa: F401

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        import opencc

        conv = opencc.OpenCC("s2t")
        return texts.map(lambda t: conv.convert(t) if t else t)

    return convert(c)
