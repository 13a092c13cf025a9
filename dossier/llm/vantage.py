"""Vantage-point trees over 64-bit fingerprints: rings as keys that Spark shuffles on, and a tree inside a shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.llm.shared import star_links

BITS, RADIUS = 64, 3
#: Every half of a fingerprint has a tree of its own, with this many levels of vantage points.
HALVES, LEVELS = 2, 8
#: Vantage points of the levels, side by side: any fixed value serves.
VANTAGE = 0x5A3C_96E1_0F78_D2B4
#: Members below which a branch of the tree inside a shard is searched one by one.
LEAF = 32
#: Links gathered in a task before they are thinned to one for each member.
LINKS_HELD = 200_000
#: Bits that a ring of 0 to 4 takes in a shard's number.
RING_BITS = 3


def rings_of(fp: Column, half: int) -> list[Column]:
    """Hamming distances of a half's bits to the vantage points of its levels."""
    width = BITS // HALVES // LEVELS
    out = []
    for level in range(LEVELS):
        low = (half * LEVELS + level) * width
        mask, seen = (1 << width) - 1, VANTAGE >> low & (1 << width) - 1
        out.append(F.bit_count(F.shiftrightunsigned(fp, low).bitwiseAND(mask).bitwiseXOR(seen)).cast("long"))
    return out


def shard_of(tree: Column | int, rings: list[Column]) -> Column:
    """Number of the shard that these rings of a tree lead to."""
    number = (F.lit(tree) if isinstance(tree, int) else tree).cast("long") * (1 << RING_BITS * LEVELS)
    for level, ring in enumerate(rings):
        number = number + ring * (1 << RING_BITS * level)
    return number


class Tree:
    """Vantage-point tree over the members of a shard."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = members
        self.split = None
        if len(members) > LEAF:
            vantage = members[len(members) // 2]
            distance = np.bitwise_count(members ^ vantage)
            middle = int(np.median(distance))
            near = distance <= middle
            if near.all():
                middle -= 1
                near = distance <= middle
            if near.any() and not near.all():
                self.split = (vantage, middle, Tree(members[near]), Tree(members[~near]))

    def pairs(self, asked: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asked, member) within the radius. A branch is passed over where the triangle bound leaves nothing in it."""
        if not len(asked):
            return
        if self.split is None:
            step = max(1, 1_000_000 // max(1, len(self.members)))
            for start in range(0, len(asked), step):
                part = asked[start:start + step]
                i, j = np.nonzero(np.bitwise_count(part[:, None] ^ self.members[None, :]) <= radius)
                yield part[i], self.members[j]
            return
        vantage, middle, near, far = self.split
        distance = np.bitwise_count(asked ^ vantage).astype(np.int64)
        yield from near.pairs(asked[distance <= middle + radius], radius)
        yield from far.pairs(asked[distance > middle - radius], radius)


class Links:
    """Links found so far in a task, thinned whenever they get many."""

    def __init__(self) -> None:
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = a != b
        if apart.any():
            self.a.append(a[apart])
            self.b.append(b[apart])
            self.n += int(apart.sum())
            if self.n > LINKS_HELD:
                a, b = star_links(np.concatenate(self.a), np.concatenate(self.b))
                self.a, self.b, self.n = [a], [b], len(a)

    def batch(self) -> pa.RecordBatch:
        a, b = star_links(np.concatenate(self.a), np.concatenate(self.b)) if self.a else (np.array([], np.uint64),) * 2
        self.a, self.b, self.n = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
