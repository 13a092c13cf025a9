"""Lists that grow inside ``aggregate``: appending to a plain array copies it each time, so they grow by blocks.

A step must not cast its accumulator: a cast of an array, even to its own type with other nullability, copies every entry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of a block. An append copies at most a block, and every BLOCK-th one the list of blocks.
BLOCK = 32


def fields(kind: str) -> str:
    """Fields ``done`` and ``open`` of an accumulator whose entries are of this type."""
    return f"done:array<array<{kind}>>,open:array<{kind}>"


def empty(kind: str) -> list[Column]:
    return [F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("open")]


def kept(acc: Column) -> list[Column]:
    return [acc["done"].alias("done"), acc["open"].alias("open")]


def push(acc: Column, entry: Column, when: Column | None = None) -> list[Column]:
    """The two fields with one entry more, or as they are where ``when`` does not hold."""
    full = F.size(acc["open"]) >= BLOCK
    done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    open_ = F.when(full, F.array(entry)).otherwise(F.concat(acc["open"], F.array(entry)))
    if when is None:
        return [done.alias("done"), open_.alias("open")]
    return [F.when(when, done).otherwise(acc["done"]).alias("done"), F.when(when, open_).otherwise(acc["open"]).alias("open")]


def whole(acc: Column) -> Column:
    return F.concat(F.flatten(acc["done"]), acc["open"])


def sums_before(sizes: Column) -> Column:
    """Sum of the sizes in front of each entry, and of all of them at the end."""
    kind = f"struct<at:int,{fields('int')}>"
    zero = F.struct(F.lit(0).alias("at"), *empty("int")).cast(kind)
    return F.aggregate(
        sizes, zero, lambda a, n: F.struct((a["at"] + n).cast("int").alias("at"), *push(a, a["at"])), lambda a: F.concat(whole(a), F.array(a["at"]))
    )
