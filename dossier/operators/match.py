"""Multi-pattern matching of keyword and term dictionaries against texts.

A dictionary is broadcast in shards of a checked size and each text is scanned once per
shard by an automaton inside the Arrow batch: linear in the text, never a text x pattern
join. Ranking, resolving and grounding happen in DataFrame expressions afterwards.
"""

from __future__ import annotations

from array import array
from collections import OrderedDict
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import normalize_for_matching, split_keywords
from dossier.operators.unnest import unnest, unnest_structs
from dossier.session import rows_within, settled

PATTERNS_PER_SHARD = 100_000

_HIT = T.StructType([T.StructField("pid", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])

# automata of the dictionaries in use, per Python worker
_built: OrderedDict[str, tuple] = OrderedDict()
_KEPT = 8
# texts of a batch that are Python strings at a time
_TEXTS = 128


def _automaton(token: str, shared):
    """(machine, pattern lengths) of a broadcast dictionary, built once per worker."""
    if token not in _built:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pid, pattern in shared.value:
            machine.add_word(pattern, machine.get(pattern, []) + [pid])
        machine.make_automaton()
        _built[token] = machine, {pid: len(p) for pid, p in shared.value}
        while len(_built) > _KEPT:
            _built.popitem(last=False)
    _built.move_to_end(token)
    return _built[token]


def _first_of_each(machine, sizes: dict[int, int], text: str):
    """First occurrence of every pattern, as (pid, last place)."""
    first: dict[int, int] = {}
    for end, ids in machine.iter(text):
        for pid in ids:
            first.setdefault(pid, end)
    return first.items()


def _every(machine, sizes: dict[int, int], text: str):
    """All occurrences."""
    return [(pid, end) for end, ids in machine.iter(text) for pid in ids]


def _apart(machine, sizes: dict[int, int], text: str):
    """Occurrences of a reading without overlaps: the one that ends first, the longest of those, then on behind it."""
    out, behind = [], 0
    for end, ids in machine.iter(text):
        usable = [(-sizes[pid], pid) for pid in ids if end + 1 - sizes[pid] >= behind]
        if usable:
            out.append((min(usable)[1], end))
            behind = end + 1
    return out


def _scan_udf(shared, read):
    """Occurrences that ``read`` picks in each text."""
    token = uuid4().hex

    @F.arrow_udf(T.ArrayType(_HIT))
    def scan(texts: pa.Array) -> pa.Array:
        machine, sizes = _automaton(token, shared)
        # a batch may hold millions of hits: they are kept as plain numbers, and texts become Python strings few at a time
        pids, stops, widths, ends = array("q"), array("i"), array("i"), array("i", [0])
        for at in range(0, len(texts), _TEXTS):
            for text in texts.slice(at, _TEXTS).to_pylist():
                for pid, end in read(machine, sizes, text or ""):
                    pids.append(pid)
                    stops.append(end)
                    widths.append(sizes[pid])
                ends.append(len(pids))
        stop = np.asarray(stops, dtype=np.int32) + 1
        start = stop - np.asarray(widths, dtype=np.int32)
        hits = pa.StructArray.from_arrays([pa.array(np.asarray(pids, dtype=np.int64)), pa.array(start), pa.array(stop)], ["pid", "start", "stop"])
        return pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), hits)

    return scan


def _shards(patterns: DataFrame, size: int) -> list:
    """Broadcast variables that together hold the whole dictionary."""
    spark = patterns.sparkSession
    patterns = patterns.where(F.coalesce("pattern", F.lit("")) != "").select("pid", "pattern")
    rows = rows_within(patterns, size)
    parts = [rows]
    if rows is None:
        count = 2 * -(-patterns.count() // size)
        parts = [
            rows_within(patterns.where(F.pmod(F.xxhash64("pid"), F.lit(count)) == s), 2 * size) for s in range(count)
        ]
        if any(p is None for p in parts):
            raise ValueError("pattern ids do not spread over shards; are they unique?")
    return [spark.sparkContext.broadcast([(r["pid"], r["pattern"]) for r in p]) for p in parts if p]


def _standard(hits: Column) -> Column:
    """Non-overlapping reading: the match that ends first wins, the longest of those, then on."""
    ordered = F.array_sort(
        F.transform(hits, lambda h: F.struct(h["stop"].alias("stop"), h["start"].alias("start"), h["pid"].alias("pid")))
    )
    kind = "struct<at:int,out:array<struct<pid:bigint,start:int,stop:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pid:bigint,start:int,stop:int>>").alias("out")).cast(kind)
    return F.aggregate(
        ordered,
        zero,
        lambda a, h: F.when(
            h["start"] >= a["at"],
            F.struct(
                h["stop"].alias("at"),
                F.concat(a["out"], F.array(F.struct(h["pid"].alias("pid"), h["start"].alias("start"), h["stop"].alias("stop")))).alias("out"),
            ),
        ).otherwise(a).cast(kind),
        lambda a: a["out"],
    )


def scan(df: DataFrame, text: str, patterns: DataFrame, mode: str = "standard", out: str = "hits",
         shard: int = PATTERNS_PER_SHARD) -> DataFrame:
    """Add ``array<struct<pid,start,stop>>`` of the patterns found in ``text``.

    patterns: pid (position in load order, unique), pattern (already normalised).
    mode 'contains': every pattern that occurs, first occurrence each.
    mode 'standard': non-overlapping matches in text order.
    """
    if mode not in ("contains", "standard"):
        raise ValueError("mode must be contains or standard")
    shared = _shards(patterns, shard)
    # one automaton reads without overlaps by itself; the places of several are put in order first
    read = _first_of_each if mode == "contains" else _apart if len(shared) == 1 else _every
    found = [_scan_udf(b, read)(F.col(text)) for b in shared]
    hits = F.concat(*found) if found else F.array().cast(T.ArrayType(_HIT))
    df = df.withColumn(out, hits)
    return df.withColumn(out, _standard(F.col(out))) if read is _every else df


def hit_rows(df: DataFrame, keys: list[str], text: str, patterns: DataFrame, mode: str) -> DataFrame:
    """The matches of :func:`scan` as rows: (keys, pid, start, stop)."""
    columns = list(dict.fromkeys([*keys, text]))
    return unnest_structs(scan(df.select(*columns), text, patterns, mode), keys, "hits", ["pid", "start", "stop"])


# --- term dictionary ---------------------------------------------------------------------


def load_dictionary(terms: DataFrame) -> DataFrame:
    """Official terms (zh, en, ord): both sides filled; a repeated zh keeps its first place and last value."""
    ok = terms.where((F.coalesce("zh", F.lit("")) != "") & (F.coalesce("en", F.lit("")) != ""))
    return ok.groupBy("zh").agg(F.max_by("en", "ord").alias("en"), F.min("ord").alias("ord"))


def dictionary_patterns(official: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """(pid, pattern, zh, en, is_stem) from official terms and stems.

    Terms that normalise alike are one pattern with the last spelling and value. A stem
    equal to an official pattern is left out; a stem of an unknown term keeps '' as its value.
    """
    norm = official.withColumn("pattern", normalize_for_matching(F.col("zh"))).where(F.col("pattern") != "")
    base = norm.groupBy("pattern").agg(
        F.min("ord").alias("ord"), F.max_by("zh", "ord").alias("zh"), F.max_by("en", "ord").alias("en")
    )
    base = base.withColumn("is_stem", F.lit(False))
    if stems is not None:
        s = stems.select(
            normalize_for_matching(F.col("stem")).alias("pattern"), F.col("official").alias("zh"),
            normalize_for_matching(F.col("official")).alias("full"), F.col("ord"),
        ).where((F.col("pattern") != "") & (F.col("full") != ""))
        s = s.groupBy("pattern").agg(F.max_by(F.struct("zh", "full"), "ord").alias("t"), F.min("ord").alias("ord"))
        s = s.join(base.select("pattern"), "pattern", "left_anti")
        s = s.join(base.select(F.col("pattern").alias("full"), "en"), s["t"]["full"] == F.col("full"), "left")
        top = base.agg(F.max("ord")).withColumnRenamed("max(ord)", "__top")
        s = s.select("pattern", (F.col("ord") + F.coalesce(top.scalar(), F.lit(0)) + 1).alias("ord"), F.col("t")["zh"].alias("zh"),
                     F.coalesce("en", F.lit("")).alias("en"), F.lit(True).alias("is_stem"))
        base = base.unionByName(s)
    return base.withColumnRenamed("ord", "pid")


def term_hits(df: DataFrame, keys: list[str], text: str, patterns: DataFrame, mode: str = "standard") -> DataFrame:
    """Matched terms per text: (keys, zh, en, pos).

    ``pos`` is the place of the first occurrence, or the load order in contains mode,
    where stems take no part.
    """
    patterns = settled(patterns.where(~F.col("is_stem")) if mode == "contains" else patterns)
    found = hit_rows(df, keys, text, patterns, mode)
    place = F.col("pid") if mode == "contains" else F.col("start")
    rows = found.join(patterns.select("pid", "zh", "en"), "pid").withColumn("pos", place.cast("bigint"))
    # a term has one English value, so it can be part of the key and the aggregation stays hashed
    return rows.groupBy(*keys, "zh", "en").agg(F.min("pos").alias("pos"))


def grounded_terms(df: DataFrame, keys: list[str], query: str, context: str, patterns: DataFrame, mode: str = "standard") -> DataFrame:
    """Terms of question and context that the context supports.

    A term stays when it is found in the context alone, or when its full official form is
    in the question. A dictionary without stems needs no grounding.
    """
    n_query, n_context = normalize_for_matching(F.col(query)), normalize_for_matching(F.col(context))
    patterns = settled(patterns)
    texts = df.select(*keys, n_query.alias("__q"), n_context.alias("__c")).withColumn(
        "__all", F.when(F.col("__c") != "", F.concat("__q", F.lit("\n"), "__c")).otherwise(F.col("__q"))
    )
    any_stem = patterns.where("is_stem").limit(1).agg((F.count("*") > 0).alias("x")).scalar()
    usable = patterns.where(~F.col("is_stem")) if mode == "contains" else patterns
    # both texts of a row are read in one pass, and their hits meet in one aggregation
    both = scan(scan(texts, "__all", usable, mode, "__everywhere"), "__c", usable, mode, "__inside")
    told = lambda c, inside: F.transform(c, lambda h: F.struct(h["pid"].alias("pid"), h["start"].alias("start"), F.lit(inside).alias("inside")))
    hits = unnest_structs(both, keys, F.concat(told("__everywhere", False), told("__inside", True)), ["pid", "start", "inside"])
    place = F.when(~F.col("inside"), F.col("pid" if mode == "contains" else "start").cast("bigint"))
    found = hits.join(usable.select("pid", "zh", "en"), "pid").groupBy(*keys, "zh", "en").agg(F.min(place).alias("pos"), F.max("inside").alias("__in"))
    rows = found.where(F.col("pos").isNotNull()).join(texts.select(*keys, "__q"), keys)
    full = F.contains(F.col("__q"), normalize_for_matching(F.col("zh")))
    return rows.where(F.col("__in") | full | ~any_stem).select(*keys, "zh", "en", "pos")


def english_hits(df: DataFrame, keys: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """Official terms whose English value occurs in the text, case aside."""
    low = settled(patterns.where(~F.col("is_stem") & (F.col("en") != "")).select("pid", "zh", "en", F.lower("en").alias("pattern")))
    found = hit_rows(df.select(*keys, F.lower(text).alias("__t")), keys, "__t", low, "contains")
    return found.join(low.select("pid", "zh", "en"), "pid").select(*keys, "zh", "en", F.col("pid").alias("pos"))


def dictionary_xml(zh_en_pairs: Column) -> Column:
    """Prompt block of ``array<struct<zh,en>>``."""
    rows = F.transform(zh_en_pairs, lambda t: F.concat(F.lit("  <term><zh>"), t["zh"], F.lit("</zh><en>"), t["en"], F.lit("</en></term>")))
    return F.when(
        F.size(zh_en_pairs) > 0,
        F.concat(F.lit("<Mandatory_Dictionary>\n"), F.array_join(rows, "\n"), F.lit("\n</Mandatory_Dictionary>")),
    ).otherwise(F.lit("<Mandatory_Dictionary></Mandatory_Dictionary>"))


# --- responsible units -------------------------------------------------------------------


def unit_keywords(units: DataFrame) -> DataFrame:
    """(agency, unit, keyword, ord, extended) one row per keyword.

    units: ord, agency, unit, keywords (one cell), extended (array).
    """
    base = units.select(F.coalesce("agency", F.lit("")).alias("agency"), F.coalesce("unit", F.lit("")).alias("unit"), "ord", "keywords", "extended")
    cell = split_keywords(F.coalesce("keywords", F.lit("")))
    own = unnest(base, ["agency", "unit", "ord", F.lit(False).alias("more")], cell, "keyword", "k")
    more = unnest(base, ["agency", "unit", "ord", F.lit(True).alias("more")], "extended", "keyword", "k")
    rows = own.unionByName(more.withColumn("keyword", F.trim("keyword"))).where(F.coalesce("keyword", F.lit("")) != "")
    rows = rows.withColumnRenamed("more", "extended")
    # load order as one number: row, own keywords before extended ones, position in the cell
    place = F.col("ord").cast("bigint") * 2**21 + F.col("extended").cast("bigint") * 2**20 + F.col("k")
    return rows.select("agency", "unit", "keyword", "extended", place.alias("place"))


def unit_profile(units: DataFrame) -> DataFrame:
    """Ordered distinct keywords of every (agency, unit)."""
    rows = unit_keywords(units).where((F.col("agency") != "") | (F.col("unit") != ""))
    once = rows.groupBy("agency", "unit", "keyword").agg(F.min("place").alias("place"))
    return once.groupBy("agency", "unit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]), "、").alias("keywords"),
        F.min("place").alias("place"),
    )


def intent_patterns(units: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(pid, pattern, agency, unit): unit keywords in load order, then aliases.

    An alias (standard, alias, ord) goes to the unit of its standard keyword: the exact
    one (the last row with it wins, extended keywords only where no own keyword has it), else the
    first keyword in load order that contains it or is contained in it.
    """
    words = unit_keywords(units).withColumn("pattern", normalize_for_matching(F.col("keyword"))).where(F.col("pattern") != "")
    words = words.withColumn("pid", F.col("place"))
    if aliases is None:
        return words.select("pid", "pattern", "agency", "unit")
    owner = settled(lookup_map(words))
    std = aliases.select("standard", "alias", "ord").withColumn("n_std", normalize_for_matching(F.col("standard")))
    exact = std.join(owner.select(F.col("pattern").alias("n_std"), F.struct("agency", "unit").alias("o")), "n_std", "left")
    miss = exact.where(F.col("o").isNull()).select("n_std").distinct()
    fuzzy = containment_first(miss, "n_std", owner)
    full = exact.join(fuzzy, "n_std", "left").withColumn("o", F.coalesce("o", "fuzzy")).where(F.col("o").isNotNull())
    full = full.withColumn("pattern", normalize_for_matching(F.col("alias"))).where(F.col("pattern") != "")
    full = full.join(owner.select("pattern"), "pattern", "left_anti")
    extra = full.withColumn("pid", F.col("ord").cast("bigint") + F.lit(2**61))  # behind every keyword
    return words.select("pid", "pattern", "agency", "unit").unionByName(
        extra.select("pid", "pattern", F.col("o")["agency"].alias("agency"), F.col("o")["unit"].alias("unit"))
    )


def lookup_map(words: DataFrame) -> DataFrame:
    """Owner of each pattern: the last own keyword, else the first extended one; ``ord`` of first insertion."""
    own = words.where(~F.col("extended")).groupBy("pattern").agg(F.max_by(F.struct("agency", "unit"), "pid").alias("own"), F.min("pid").alias("p1"))
    more = words.where("extended").groupBy("pattern").agg(F.min_by(F.struct("agency", "unit"), "pid").alias("more"), F.min("pid").alias("p2"))
    both = own.join(more, "pattern", "full_outer").withColumn("o", F.coalesce("own", "more"))
    return both.select("pattern", F.col("o")["agency"].alias("agency"), F.col("o")["unit"].alias("unit"), F.least("p1", "p2").alias("ord"))


def containment_first(texts: DataFrame, text: str, owner: DataFrame) -> DataFrame:
    """(text, fuzzy): the first owner whose pattern contains the text or lies in it.

    Two automaton scans, one per direction, instead of a pairwise join.
    """
    pats = owner.select(F.col("ord").alias("pid"), "pattern", F.struct("agency", "unit").alias("o"))
    inside = hit_rows(texts, [text], text, pats, "contains").select(text, "pid")
    # ids that do not depend on the order of rows
    tids = texts.where(F.col(text) != "").select(F.xxhash64(text).alias("pid"), F.col(text).alias("pattern"))
    around = hit_rows(pats.select(F.col("pid").alias("owner"), "pattern"), ["owner"], "pattern", tids, "contains")
    around = around.select(F.col("owner").alias("pid"), F.col("pid").alias("tid")).join(tids.select(F.col("pid").alias("tid"), F.col("pattern").alias(text)), "tid").select(text, "pid")
    first = inside.unionByName(around).groupBy(text).agg(F.min("pid").alias("pid"))
    return first.join(pats.select("pid", F.col("o").alias("fuzzy")), "pid").select(text, "fuzzy")


def classify(df: DataFrame, keys: list[str], text: str, patterns: DataFrame, top_n: int = 1, mode: str = "standard") -> DataFrame:
    """Responsible units per text: longest match first, distinct units, first ``top_n``.

    (keys, agency, unit, keyword, rank)
    """
    patterns = settled(patterns)
    norm = df.select(*keys, normalize_for_matching(F.col(text)).alias("__t"))
    # a table of few pieces is dealt out first: the matches of a text are many times its size, and the task that finds them sorts them
    found = hit_rows(norm.repartition(*keys, "__t"), keys, "__t", patterns, mode)
    place = F.col("pid") if mode == "contains" else F.col("start").cast("bigint")
    rows = found.join(patterns, "pid").withColumn(
        "strength", F.struct((-F.length("pattern")).alias("len"), place.alias("place"))
    )
    best = rows.groupBy(*keys, "agency", "unit").agg(F.min(F.struct("strength", "pattern")).alias("b"))
    order = Window.partitionBy(*keys).orderBy(F.col("b")["strength"])
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return ranked.select(*keys, "agency", "unit", F.col("b")["pattern"].alias("keyword"), "rank")
