"""Arrays to rows without computing the array twice.

For ``explode`` and ``inline`` the optimizer infers a ``size(array) > 0`` filter and pushes
it towards the scan, which evaluates a computed array once more (for a Python function:
one more trip to Python). The outer generators get no such filter; empty arrays are
dropped after the generator instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, value: str, index: str = "__pos") -> DataFrame:
    """One row per element of an array of plain values, with its 0-based position."""
    out = df.select(*keep, F.posexplode_outer(array).alias(index, value)).where(F.col(index).isNotNull())
    return out.drop("__pos")


def unnest_structs(df: DataFrame, keep: list, array: Column | str, fields: list[str], index: str = "__pos") -> DataFrame:
    """One row per struct of an array, its fields as columns.

    ``inline`` keeps the array evaluated once; reading fields of an exploded struct would
    be pushed below the generator field by field.
    """
    array = F.col(array) if isinstance(array, str) else array
    rows = F.transform(array, lambda s, i: F.struct(i.alias(index), *[s[f].alias(f) for f in fields]))
    out = df.select(*keep, F.inline_outer(rows)).where(F.col(index).isNotNull())
    return out.drop("__pos")
