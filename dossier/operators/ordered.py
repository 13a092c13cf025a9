"""Running computations over an ordered group that may hold a third of all rows.

A plain window sends a whole group to one task. Here all rows are sorted once over many
tasks, by range of (group, order), and cut into blocks of at most ``block`` rows by their
place in that order, so neither a hot group nor equal order values make a block longer.
Every block is reduced to one summary row for each group in it, only those summaries are
scanned per group, and a second pass adds what the blocks in front hold.

``block=None`` asks for the plain window. It is for groups that came out of one source row
(the lines of a document, the items of an answer), which that row already bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.session import settled

BLOCK = 65_536


@dataclass(frozen=True)
class Running:
    """``agg`` is max, min, sum, count or last (not null) of ``value`` over the rows up to the current one.

    ``exclusive`` leaves the current row out, ``backward`` runs from the last row to the first.
    """

    value: Column
    agg: str = "max"
    exclusive: bool = False
    backward: bool = False


_AGGS = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def _plain(spec: Running) -> str:
    """The aggregate that finds it: the last value is that with the largest place, or the smallest where the rows run backward."""
    return spec.agg if spec.agg != "last" else "min" if spec.backward else "max"


def _placed(spec: Running, place: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(place.alias("at"), value.alias("v"))) if spec.agg == "last" else value


def _over(spec: Running, value: Column, group: list[str], order: list[str]) -> Column:
    by = [F.col(c).desc() if spec.backward else F.col(c).asc() for c in order]
    last = -1 if spec.exclusive else 0
    return _AGGS[_plain(spec)](value).over(Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, last))


def _hashable(kind: T.DataType) -> bool:
    """Whether a column may break ties by its hash: maps and what holds them may not."""
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def laid_out(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column] | None = None, place: str = "__p") -> DataFrame:
    """``df`` with ``values``, sorted by keys and order over all tasks and settled, with the number ``place`` that rises in that order.

    Rows of equal order are taken by a hash of their columns, so the order is the same in every run but for equal rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)])
    by = [*keys, *order, "__same", "__row"]
    rows = df.withColumns({**(values or {}), "__same": tie, "__row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__same", "__row")
    return settled(rows.withColumn(place, F.monotonically_increasing_id()))


def running(
    df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, Running], block: int | None = BLOCK
) -> DataFrame:
    """Add one column per output. Keys are not null; nulls of the order come first."""
    if block is None:
        place = F.struct(*[F.col(c) for c in order])
        for name, spec in outputs.items():
            found = _over(spec, _placed(spec, place, spec.value), keys, order)
            df = df.withColumn(name, found["v"] if spec.agg == "last" else found)
        return df
    df = laid_out(df, keys, order, {f"__v_{name}": spec.value for name, spec in outputs.items()})
    df = df.withColumns({"__blk": F.floor(F.col("__p") / F.lit(block)), **{f"__v_{n}": _placed(s, F.col("__p"), F.col(f"__v_{n}")) for n, s in outputs.items()}})
    group = [*keys, "__blk"]
    summary = df.groupBy(*group).agg(*[_AGGS[_plain(s)](f"__v_{n}").alias(f"__s_{n}") for n, s in outputs.items()])
    inner = df
    for name, spec in outputs.items():
        blk = F.col("__blk").desc() if spec.backward else F.col("__blk").asc()
        inner = inner.withColumn(f"__i_{name}", _over(spec, F.col(f"__v_{name}"), group, ["__p"]))
        carry = F.sum if spec.agg in ("sum", "count") else _AGGS[_plain(spec)]
        summary = summary.withColumn(
            f"__c_{name}",
            carry(f"__s_{name}").over(
                Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
    summary = summary.select(*group, *[f"__c_{n}" for n in outputs])
    out = inner.join(summary, group, "left")
    for name, spec in outputs.items():
        here, before = F.col(f"__i_{name}"), F.col(f"__c_{name}")
        if spec.agg in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            value = (F.greatest if _plain(spec) == "max" else F.least)(here, before)
        value = value["v"] if spec.agg == "last" else value
        out = out.withColumn(name, value).drop(f"__i_{name}", f"__c_{name}", f"__v_{name}")
    return out.drop("__blk", "__p")


def carry_forward(df, keys, order, outputs: dict[str, Column], block: int | None = BLOCK) -> DataFrame:
    """Last non-null value at or before each row."""
    return running(df, keys, order, {n: Running(v, "last") for n, v in outputs.items()}, block)


def _neighbour(df, keys, order, outputs: dict[str, Column], block: int | None, backward: bool) -> DataFrame:
    specs = {n: Running(F.struct(v.alias("x")), "last", exclusive=True, backward=backward) for n, v in outputs.items()}
    return running(df, keys, order, specs, block).withColumns({n: F.col(n)["x"] for n in outputs})


def previous(df, keys, order, outputs: dict[str, Column], block: int | None = BLOCK) -> DataFrame:
    """Value of the row in front (a value that may itself be null comes back as null)."""
    return _neighbour(df, keys, order, outputs, block, backward=False)


def following(df, keys, order, outputs: dict[str, Column], block: int | None = BLOCK) -> DataFrame:
    """Value of the next row."""
    return _neighbour(df, keys, order, outputs, block, backward=True)


def row_index(df, keys, order, name: str = "row_index", block: int | None = BLOCK) -> DataFrame:
    """0-based position inside the group."""
    out = running(df, keys, order, {name: Running(F.lit(1), agg="count")}, block)
    return out.withColumn(name, F.col(name) - 1)


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, right_tie: str,
    outputs: list[str], block: int | None = BLOCK,
) -> DataFrame:
    """Backward as-of join: the last right row at or before each left row, by (pos, tie).

    Both sides are stacked and the right values carried forward, so there is no pair
    of rows beyond the input. Left rows without a match get nulls.
    """
    value = F.struct(*[F.col(c) for c in outputs])
    nothing = F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType)
    l_side = left.withColumns(
        {"__pos": F.col(left_pos).cast("bigint"), "__right": F.lit(1), "__tie": F.lit(0).cast("bigint"), "__val": nothing}
    )
    r_side = right.select(
        *keys, F.col(right_pos).cast("bigint").alias("__pos"), F.lit(0).alias("__right"),
        F.col(right_tie).cast("bigint").alias("__tie"), value.alias("__val"),
    )
    stacked = l_side.unionByName(r_side, allowMissingColumns=True)
    done = carry_forward(stacked, keys, ["__pos", "__right", "__tie"], {"__hit": F.col("__val")}, block)
    return (
        done.where(F.col("__right") == 1)
        .withColumns({c: F.col("__hit")[c] for c in outputs})
        .drop("__pos", "__right", "__tie", "__val", "__hit")
    )


def interval_first(
    points: DataFrame, ranges: DataFrame, keys: list[str], point: str, start: str, stop: str, rank: str,
    outputs: list[str], width: int = 64,
) -> DataFrame:
    """For each point the first range (by ``rank``) with start <= point <= stop.

    Ranges are spread over buckets of ``width`` positions, so the join is an equi-join on
    (keys, bucket) that splits a hot key, and the winner is chosen by partial aggregation.
    """
    spread = ranges.withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width)))
    ).select(*keys, "__b", F.col(start).alias("__s"), F.col(stop).alias("__e"), F.struct(F.col(rank).alias("r"), *outputs).alias("__o"))
    wanted = points.select(*keys, point).distinct().withColumn("__b", F.floor(F.col(point) / width))
    best = (
        wanted.join(spread, [*keys, "__b"])
        .where(F.col(point).between(F.col("__s"), F.col("__e")))
        .groupBy(*keys, point)
        .agg(F.min("__o").alias("__o"))
    )
    return points.join(best, [*keys, point], "left").withColumns({c: F.col("__o")[c] for c in outputs}).drop("__o")
