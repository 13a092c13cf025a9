"""Filter interaction audit: what every order of the filters keeps, removes and loses, by relations of failing ids."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.shared import content_of, shared_path, stored

#: Copies of the smaller side of a join on a key that a third of all rows may share; its other side is dealt over them.
SALTS = 16
#: White space of the word class ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"
#: The filter that looks at the whole table instead of at one text.
COPY = "E"


def text_filters(text: str) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null, as columns."""
    words = F.array_remove(F.split(F.col(text), SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": F.col(text).rlike(r"[#$%&*|]"),
    }


def _dealt(left: DataFrame, right: DataFrame, on: Column, how: str) -> DataFrame:
    """``left`` joined with ``right`` by ``on`` where rows of one key of ``left`` are spread over SALTS keys; ``left`` has a number ``row``."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(salted, on & (F.pmod("row", F.lit(SALTS)).cast("int") == F.col("_salt")), how).drop("_salt")


def facts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``row, doc_id, part, good, toxic, content, failed``: one stored row a document, ``failed`` the names of the filters on texts that it fails."""
    plain = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    tests = text_filters("text") if filters is None else filters
    failed = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))).cast("array<string>")
    seen = plain.select("doc_id", "part", content_of("text").alias("content"), failed.alias("failed"))
    seen = stored(seen.withColumn("row", F.monotonically_increasing_id()), "filter-facts")
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    marked = _dealt(seen, marks, F.col("doc_id") == F.col("_key"), "left")
    return stored(marked.select("row", "doc_id", "part", "content", "failed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))), "filter-rows")


def copies(rows: DataFrame) -> DataFrame:
    """Rows of ``facts`` whose text a smaller key has, anywhere in the table."""
    firsts = rows.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("content").alias("_content"), "first")
    return _dealt(rows, firsts, (F.col("content") == F.col("_content")) & (F.col("doc_id") > F.col("first")), "left_semi")


def failing_relations(rows: DataFrame) -> DataFrame:
    """``row, doc_id, part, filter`` of failing rows: a stored table of ids for each filter, in a folder of its own."""
    kept = ["row", "doc_id", "part"]
    own = rows.select(*kept, F.explode("failed").alias("filter"))
    path = shared_path(rows.sparkSession, "failing-ids")
    own.union(copies(rows).select(*kept, F.lit(COPY).alias("filter"))).write.partitionBy("filter").parquet(path)
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("filter", T.StringType())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def prefix_counts(rows: DataFrame, failing: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """``part, prefix, n`` of the survivors of every set of filters, and ``part, prefix, filter, removed, good_lost, toxic_lost`` of every next filter.

    Orders that begin with the same filters share a prefix (a bit mask), so 32 prefixes serve all 120 orders. Prefixes of one length are one stored
    relation of surviving rows: its left-semi join with the failing ids of the filters that may come next is what these remove, its left-anti join the
    survivors of longer prefixes. Rows that fail nothing survive everything and are only counted.
    """
    failing = failing.select("row", "filter")
    in_all = rows.join(failing, "row", "left_anti").groupBy("part").agg(F.count("*").alias("n"))
    state = stored(rows.join(failing, "row", "left_semi").select("row", "part", "good", "toxic", F.lit(0).alias("prefix")), "survivors")
    counted, removals = [], []
    for length in range(len(names) + 1):
        counted.append(state.groupBy("part", "prefix").agg(F.count("*").alias("n")))
        if length == len(names):
            break
        bits = [(F.lit(name), F.lit(1 << at)) for at, name in enumerate(names)]

        def next_filters(allowed) -> DataFrame:
            options = F.array_compact(F.array(*(F.when(allowed(bit), F.struct(name.alias("filter"), bit.alias("bit"))) for name, bit in bits)))
            return state.select("*", F.explode(options).alias("_next")).select("row", "part", "good", "toxic", "prefix", "_next.*")

        sums = (F.count("*").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
        open_ = next_filters(lambda bit: F.col("prefix").bitwiseAND(bit) == 0)
        removals.append(open_.join(failing, ["row", "filter"], "left_semi").groupBy("part", "prefix", "filter").agg(*sums))
        # every set is reached once, its filters in their own order
        longer = next_filters(lambda bit: F.col("prefix") < bit).join(failing, ["row", "filter"], "left_anti")
        state = stored(longer.select("row", "part", "good", "toxic", F.col("prefix").bitwiseOR(F.col("bit")).alias("prefix")), "survivors")
    clean = in_all.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    return _union([*counted, clean.select("part", "prefix", "n")]).groupBy("part", "prefix").agg(F.sum("n").alias("n")), _union(removals)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every order of the filters, step and part.

    ``filters`` maps names of one letter to failure conditions on a column ``text`` (never null); the built-in ones are A to D. E, whose rows copy the text of a
    smaller key, is always the last. Null texts count as empty, null parts as the part ``''``. A row without a key has no label, is no copy and no
    original; keys without regard to order or repetition are rows of their own, and rows equal in key and text are no copies of each other. Of several
    labels of a key the good and the toxic one count. No rows give no parts; further columns play no part.

    Redundant are failing rows less those removed in this step; ``unique_fails`` is what the filter removes after all others; ``shapley`` sums what it
    removes over all orders.
    """
    names = [*(text_filters("text") if filters is None else filters), COPY]
    rows = facts(docs, labels, filters, key, text, part)
    kept, removals = prefix_counts(rows, failing_relations(rows), names)
    kept, removals = stored(kept, "kept"), stored(removals, "removals")

    everything = (1 << len(names)) - 1
    bits = {name: 1 << at for at, name in enumerate(names)}
    places = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, start=1):
            places.append((len(places), "".join(order), step, name, before, before | bits[name], everything & ~bits[name]))
            before |= bits[name]
    # bounded by the number of filters, whatever the table
    plan = F.broadcast(rows.sparkSession.createDataFrame(places, "place int, filter_order string, step int, filter string, prefix int, after int, others int"))
    parts = kept.select("part").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(places) - 1))))
    whole = removals.where("prefix = 0").select("part", "filter", F.col("removed").alias("failing"))

    def zeros(*names: str) -> list[Column]:
        return [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names]

    cells = parts.join(plan, "place")
    cells = cells.join(kept.select("part", F.col("prefix").alias("after"), F.col("n").alias("kept")), ["part", "after"], "left")
    cells = cells.join(removals, ["part", "prefix", "filter"], "left").join(whole, ["part", "filter"], "left")
    cells = cells.join(removals.select("part", "filter", F.col("prefix").alias("others"), F.col("removed").alias("unique_fails")), ["part", "filter", "others"], "left")
    cells = cells.select("part", "filter_order", "step", "filter", *zeros("kept", "removed", "failing", "unique_fails", "good_lost", "toxic_lost"))
    shares = cells.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return cells.join(shares, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
