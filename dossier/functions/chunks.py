"""Chunking as array expressions: one row in, one array of pieces out, no shuffle.

A text is first cut into blocks of ``step`` characters in one linear regex pass; a
chunk is a block plus the head of the blocks after it. Taking ``substring`` per chunk
would walk the UTF-8 text from its start each time and turn quadratic on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import growing as G
from dossier.functions.text import WS, let, strip
from dossier.params import BLOCK_LIMIT, MACRO_CHUNK_SIZE, ChunkParams

_ALL = 2**30  # slice adds start and length as 32-bit integers


def _cut(c: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters."""
    return F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


def sliding_chunks(c: Column, params: ChunkParams = ChunkParams(), keep_blank: bool = True) -> Column:
    """Array of overlapping pieces, each trimmed, blank pieces left out.

    A blank but non-empty text gives one empty piece when ``keep_blank`` (the ingest
    path embeds a placeholder for it) and none otherwise (the mining path).
    """
    return let(strip(c), lambda text: F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(_pieces(text, params, keep_blank)))


def _pieces(text: Column, params: ChunkParams, keep_blank: bool) -> Column:
    return let(_cut(text, params.step), lambda blocks: _overlapping(text, blocks, params, keep_blank))


def _overlapping(text: Column, blocks: Column, params: ChunkParams, keep_blank: bool) -> Column:
    joined = blocks
    for nxt in range(1, -(-params.overlap // params.step) + 1):
        joined = F.zip_with(
            joined, F.slice(blocks, nxt + 1, _ALL), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
        )
    count = F.ceil((F.length(text) - params.size) / params.step).cast("int") + 1
    pieces = F.filter(
        F.transform(
            F.slice(joined, 1, F.greatest(count, F.lit(1))), lambda p: strip(F.left(p, F.lit(params.size)))
        ),
        lambda p: p != "",
    )
    none = F.array().cast("array<string>")
    blank = F.array(F.lit("")) if keep_blank else none
    return F.when(text == "", blank).when(F.length(text) <= params.size, F.array(text)).otherwise(pieces)


def macro_chunks(c: Column, size: int = MACRO_CHUNK_SIZE) -> Column:
    """Pieces that start at level 1-2 headings, cut at ``size``.

    Text in front of the first heading is dropped as soon as there is a heading.
    """
    parts = F.split(c, rf"(?md)(?=^#{{1,2}}[{WS}])")
    headed = F.filter(parts, lambda p: p.rlike(rf"^#{{1,2}}[{WS}]"))
    sections = F.when(F.size(headed) > 0, F.transform(headed, strip)).otherwise(F.array(c))
    pieces = F.flatten(F.transform(sections, lambda s: _cut(s, size)))
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def greedy_ranges(sizes: Column, limit: int, lone_over_limit: bool = False) -> Column:
    """Pack consecutive sizes into ranges whose sum stays within ``limit``.

    Returns ``array<struct<s,e>>`` of half-open index ranges. An entry that would
    overflow a non-empty range opens the next one; an entry larger than the limit
    stays a range of its own. With ``lone_over_limit`` nothing joins it either.
    """
    one = "array<struct<s:int,e:int>>"
    kind = f"struct<i:int,s:int,len:bigint,{G.fields(one)}>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("len"), *G.empty(one)).cast(kind)

    def rng(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.alias("s"), b.alias("e"))).cast(one)

    def step(acc: Column, size: Column) -> Column:
        i, s, held = acc["i"], acc["s"], acc["len"]
        open_ = i > s
        over = open_ & (held + size > limit)
        nxt = F.struct(
            (i + 1).alias("i"), F.when(over, i).otherwise(s).alias("s"), F.when(over, size).otherwise(held + size).cast("bigint").alias("len"), *G.push(acc, rng(s, i), over)
        )
        if not lone_over_limit:
            return nxt
        closed = F.when(open_, F.concat(rng(s, i), rng(i, i + 1))).otherwise(rng(i, i + 1))
        alone = F.struct((i + 1).alias("i"), (i + 1).alias("s"), F.lit(0).cast("bigint").alias("len"), *G.push(acc, closed))
        return F.when(size > limit, alone).otherwise(nxt)

    def finish(acc: Column) -> Column:
        out = F.flatten(G.whole(acc))
        return F.when(acc["i"] > acc["s"], F.concat(out, rng(acc["s"], acc["i"]))).otherwise(out)

    return F.aggregate(sizes, zero, step, finish)


def _pack(parts: Column, extra: int, limit: int, glue: str) -> Column:
    """Texts of the packed ranges of ``parts``; each part weighs its length plus ``extra``."""
    sizes = F.transform(parts, lambda p: (F.length(p) + extra).cast("bigint"))
    return F.transform(
        greedy_ranges(sizes, limit), lambda r: F.array_join(F.slice(parts, r["s"] + 1, r["e"] - r["s"]), glue)
    )


# A Markdown heading line, and candidates for headings of a long document.
HEADING = rf"(?md)^#{{1,6}}[{WS}]+.+$"
HEADING_CANDIDATE = (
    rf"(?imd)^(#{{1,6}}[{WS}]+.+|\*\*[^*]+\*\*|"
    rf"(?:Part|Section|Chapter|Annex|Appendix)[{WS}]+[A-Z0-9]+.*)$"
)


def last_parent_heading(c: Column) -> Column:
    """The last heading of the shallowest level that occurs in the text, '' without headings."""
    found = F.regexp_extract_all(c, F.lit(HEADING), F.lit(0))
    level = lambda h: F.when(
        h.rlike(rf"^#{{1,6}}[{WS}]"), F.length(F.regexp_extract(h, r"^(#{1,6})", 1))
    ).otherwise(999)
    tagged = F.transform(found, lambda h, i: F.struct((-level(h)).alias("depth"), i.alias("i"), h.alias("h")))
    return F.coalesce(strip(F.array_max(tagged)["h"]), F.lit(""))


def sections(df: DataFrame, text: str, out: str = "sections") -> DataFrame:
    """Add ``array<struct<heading, text, start, stop>>``: the document cut at every heading.

    Offsets are characters of the source. A document without a heading gets an empty array.
    """
    parts = F.split(F.col(text), rf"(?md)(?=^#{{1,6}}[{WS}]+.)")
    df = df.withColumn("__parts", parts)
    head = lambda p: F.regexp_extract(p, rf"(?d)^#{{1,6}}[{WS}]+.+", 0)
    ends = G.sums_before(F.transform("__parts", F.length))
    df = df.withColumn("__ends", ends)
    raw = F.transform(
        F.arrays_zip(F.col("__parts").alias("p"), F.slice("__ends", 1, _ALL).alias("a"), F.slice("__ends", 2, _ALL).alias("b")),
        lambda z: F.struct(
            head(z["p"]).alias("heading"),
            F.when(
                head(z["p"]) != "",
                strip(F.concat(head(z["p"]), F.lit("\n"), strip(F.substr(z["p"], F.length(head(z["p"])) + 1)))),
            ).otherwise(strip(z["p"])).alias("text"),
            z["a"].alias("start"),
            z["b"].alias("stop"),
        ),
    )
    kept = F.filter(raw, lambda s: s["text"].isNotNull() & ((s["heading"] != "") | (s["text"] != "")))
    return df.withColumn(
        out, F.when(F.exists(kept, lambda s: s["heading"] != ""), kept).otherwise(F.slice(kept, 1, 0))
    ).drop("__parts", "__ends")


def semantic_chunks(df: DataFrame, text: str, out: str = "chunks", limit: int = BLOCK_LIMIT) -> DataFrame:
    """Add ``array<struct<text, start, stop, heading>>``: blocks of at most ``limit`` characters.

    Sections are packed in order; the packed length ignores the blank lines put between
    them. A section over the limit is cut at line ends on its own. Without any heading,
    paragraphs are packed and a single long paragraph is not cut.
    """
    df = sections(df, text, "__sec")
    sec, src = F.col("__sec"), F.col(text)
    sizes = F.transform(sec, lambda s: F.length(s["text"]).cast("bigint"))
    df = df.withColumn("__rng", greedy_ranges(sizes, limit, lone_over_limit=True))

    def with_offsets(texts: Column, start: Column, fallback: Column) -> Column:
        """Sub-blocks laid end to end from ``start``; removed separators are not counted."""
        one = "struct<text:string,start:int,stop:int,heading:string>"
        kind = f"struct<at:int,{G.fields(one)}>"

        def add(a: Column, t: Column) -> Column:
            above = last_parent_heading(t)
            entry = F.struct(t.alias("text"), a["at"].alias("start"), (a["at"] + F.length(t)).alias("stop"), F.when(above == "", fallback).otherwise(above).alias("heading"))
            return F.struct((a["at"] + F.length(t)).alias("at"), *G.push(a, entry.cast(one)))

        return F.aggregate(texts, F.struct(start.cast("int").alias("at"), *G.empty(one)).cast(kind), add, G.whole)

    def packed(r: Column) -> Column:
        part = F.slice(sec, r["s"] + 1, r["e"] - r["s"])
        first, last = F.element_at(part, 1), F.element_at(part, -1)
        body = F.array_join(F.transform(part, lambda s: s["text"]), "\n\n")
        whole = F.array(
            F.struct(
                body.alias("text"), first["start"].alias("start"), last["stop"].alias("stop"),
                last_parent_heading(body).alias("heading"),
            )
        )
        cut = with_offsets(_pack(F.split(first["text"], "\n"), 1, limit, "\n"), first["start"], strip(first["heading"]))
        return F.when(F.length(first["text"]) > limit, cut).otherwise(whole)

    plain = F.when(
        F.length(src) > limit,
        with_offsets(_pack(F.split(src, r"\n{2,}"), 0, limit, "\n\n"), F.lit(0), F.lit("")),
    ).otherwise(
        F.array(F.struct(src.alias("text"), F.lit(0).alias("start"), F.length(src).alias("stop"), F.lit("").alias("heading")))
    )
    # blocks of a document without headings carry no parent heading
    plain = F.transform(plain, lambda p: p.withField("heading", F.lit("")))
    kind = "array<struct<text:string,start:int,stop:int,heading:string>>"
    return df.withColumn(
        out,
        F.when(F.size("__sec") > 0, F.flatten(F.transform("__rng", packed)).cast(kind)).otherwise(plain.cast(kind)),
    ).drop("__sec", "__rng")


def heading_candidates(c: Column, longest: int | None = 150) -> Column:
    """``array<struct<pos, line>>`` of heading-like lines, those over ``longest`` characters left out (None: all of them).

    What lies between the matches and the matches themselves are taken apart by the pattern alone, so any character may stand in the text.
    """
    one = "struct<pos:int,line:string>"
    kind = f"struct<at:int,{G.fields(one)}>"
    found = F.arrays_zip(F.split(c, HEADING_CANDIDATE).alias("gap"), F.regexp_extract_all(c, F.lit(HEADING_CANDIDATE), F.lit(0)).alias("hit"))

    def add(a: Column, z: Column) -> Column:
        at = (a["at"] + F.length(z["gap"])).cast("int")
        line = strip(z["hit"])
        fits = z["hit"].isNotNull() if longest is None else z["hit"].isNotNull() & (F.length(line) <= longest)
        entry = F.struct(at.alias("pos"), line.alias("line")).cast(one)
        return F.struct((at + F.coalesce(F.length(z["hit"]), F.lit(0))).cast("int").alias("at"), *G.push(a, entry, fits))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), *G.empty(one)).cast(kind), add, G.whole)


def structure_chunks(blocks: Column, max_tokens: int = 1200, size: int = 2000, overlap: int = 300) -> Column:
    """Pack layout blocks ``array<struct<type,text>>`` of a document into chunk texts.

    A title closes the open unit once it holds more than half of ``max_tokens``; tables
    stand alone; a paragraph that would overflow opens the next unit; an oversize
    paragraph closes the open unit and is cut hard, without overlap.
    Without titles the joined text is cut by the sliding window.
    """
    pieces = "array<string>"
    kind = f"struct<held:array<string>,n:bigint,{G.fields(pieces)}>"
    none = F.array().cast(pieces)
    zero = F.struct(none.alias("held"), F.lit(0).cast("bigint").alias("n"), *G.empty(pieces)).cast(kind)

    def unit(a: Column) -> Column:
        return F.array(F.array_join(a["held"], "\n\n"))

    def step(a: Column, b: Column) -> Column:
        text, own = b["text"], F.floor(F.length(b["text"]) / 2)
        table = b["type"].isin("table", "table_footnote")
        title = b["type"] == "title"
        close = table | (title & (a["n"] > max_tokens // 2)) | (~title & (a["n"] + own > max_tokens))
        closed = F.when(close & (F.size(a["held"]) > 0), unit(a)).otherwise(none)
        held = F.when(close, none).otherwise(a["held"])
        n = F.when(close, F.lit(0)).otherwise(a["n"]).cast("bigint")
        hard = F.filter(F.transform(_cut(strip(text), size), strip), lambda p: p != "")
        alone = table | (~title & (own > max_tokens))
        own_pieces = F.when(table, F.array(text)).when(alone, hard).otherwise(none)
        out = G.push(a, F.concat(closed, own_pieces), alone | (close & (F.size(a["held"]) > 0)))
        return F.struct(F.when(alone, held).otherwise(F.concat(held, F.array(text))).alias("held"), F.when(alone, n).otherwise(n + own).cast("bigint").alias("n"), *out)

    def finish(a: Column) -> Column:
        return F.flatten(F.when(F.size(a["held"]) > 0, F.concat(G.whole(a), F.array(unit(a)))).otherwise(G.whole(a)))

    packed = F.aggregate(blocks, zero, step, finish)
    joined = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    fallback = sliding_chunks(joined, ChunkParams(size, overlap), keep_blank=False)
    return F.when(F.exists(blocks, lambda b: b["type"] == "title"), packed).otherwise(fallback)
