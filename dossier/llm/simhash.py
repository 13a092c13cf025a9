"""SimHash fingerprints, and all pairs within a Hamming radius by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import resemblance
from dossier.llm.shared import components, over_batches, slices, stored
from dossier.llm.vantage import BITS, HALVES, LEVELS, LINKS_HELD, Links, Tree, rings_of, shard_of

SHINGLE, SEED = 3, 42
#: Members of a shard that one task holds; larger shards are cut into blocks that every visitor calls on.
SHARD_LIMIT = 50_000
#: Hashes whose bits are counted at once.
HASHES = 100_000

# The contract's words are split at ASCII white space only, with A-Z lowered.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hashes(text: str | None) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [hashed(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
    return [hashed(line[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())]


def _majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints of several hash lists: bits that more than half of a list's hashes have. An empty list gives zero."""
    sizes = np.array([len(h) for h in hashes])
    flat = np.fromiter((h for one in hashes for h in one), dtype=np.uint64, count=int(sizes.sum()))
    bits = np.unpackbits(flat.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    ones = np.zeros((len(hashes), BITS), dtype=np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        ones[filled] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[filled], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _long_majority(hashes: list[int]) -> np.ndarray:
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), HASHES):
        part = np.array(hashes[start:start + HASHES], dtype=np.uint64)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def fingerprint_of(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints as unsigned numbers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[list[int]] = []
    at: list[int] = []
    n = 0
    for i, text in enumerate(texts):
        hashes = _hashes(text)
        if len(hashes) > HASHES:
            out[i] = _long_majority(hashes)[0]
            continue
        held.append(hashes)
        at.append(i)
        n += len(hashes)
        if n > HASHES:
            out[at] = _majority(held)
            held, at, n = [], [], 0
    if at:
        out[at] = _majority(held)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = fingerprint_of(batch.column(1).to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed 64-bit number. A text without words has 0."""
    kind = docs.schema[key].dataType.simpleString()
    return over_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), _fingerprints, f"doc_id {kind}, fp long")


def shards(fps: DataFrame) -> DataFrame:
    """``shard, visitor, fp``: the upper levels of the trees, as keys that Spark shuffles on.

    Two fingerprints within 3 bits are within 1 bit in one of their halves at least. Each half has a tree whose levels look at 4 bits each;
    the ring of a level is the Hamming distance to the level's vantage point in these bits. By the triangle bound, rings of a level differ by no more
    than the fingerprints do there; the levels' bits are apart, so ring differences over a half add up to 1 at most. A fingerprint therefore
    is a member of the shard of its rings and a visitor to those one ring farther at one level: 1 + LEVELS rows a half, whatever the data.
    """
    width = BITS // HALVES // LEVELS
    out = []
    for half in range(HALVES):
        rings = rings_of(F.col("fp"), half)
        own = shard_of(half, rings)
        out.append(F.struct(own.alias("shard"), F.lit(False).alias("visitor")))
        for level, ring in enumerate(rings):
            out.append(F.when(ring < width, F.struct(shard_of(half, [r + int(i == level) for i, r in enumerate(rings)]).alias("shard"), F.lit(True).alias("visitor"))))
    return fps.select("fp", F.explode(F.array_compact(F.array(*out))).alias("at")).select("at.shard", "at.visitor", "fp")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams shards in order, members before visitors: a tree of the members, asked by members and visitors."""
    links, current, members, tree = Links(), None, [], None
    for batch in batches:
        shard, block, visitor, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        fp = fp.astype(np.int64).view(np.uint64)
        changes = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0)) + 1
        for start, end in zip([0, *changes], [*changes, len(fp)]):
            if start == end:
                continue
            if current != (shard[start], block[start]):
                if members:
                    own = np.concatenate(members)
                    for a, b in Tree(own).pairs(own):
                        links.add(a, b)
                current, members, tree = (shard[start], block[start]), [], None
            inside = start + int(np.searchsorted(visitor[start:end], True))
            if inside > start:
                members.append(fp[start:inside])
            if end > inside:
                if tree is None:
                    own = np.concatenate(members) if members else np.array([], np.uint64)
                    tree = Tree(own)
                    for a, b in tree.pairs(own):
                        links.add(a, b)
                    members = []
                for a, b in tree.pairs(fp[inside:end]):
                    links.add(a, b)
        if links.n > LINKS_HELD // 2:
            yield links.batch()
    if members:
        own = np.concatenate(members)
        for a, b in Tree(own).pairs(own):
            links.add(a, b)
    yield links.batch()


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``, each once) that join all those within 3 bits of each other.

    Every pair is compared that the trees can't rule out; of the pairs found, a task hands on one link for each member of a group, which joins
    the same fingerprints. A shard with more rows than a task should hold is cut into blocks of members, and all its rows call on every block.
    """
    placed = shards(fps)
    large = placed.groupBy("shard").count().where(F.col("count") > SHARD_LIMIT)
    large = stored(large.select("shard", F.ceil(F.col("count") / SHARD_LIMIT).cast("int").alias("blocks")), "large-shards")
    if large.isEmpty():
        placed = placed.withColumn("block", F.lit(0))
    else:
        cut = placed.join(large, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        rows = cut.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = rows.withColumn("visitor", F.col("visitor") | (F.col("block") != F.col("own")))
    ready = placed.select("shard", "block", "visitor", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = ready.repartition(parts, "shard", "block").sortWithinPartitions("shard", "block", "visitor")
    return over_batches(ready, _searched, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Words are lowered (A-Z) and split at ASCII white space; shingles are three words, repeats included. Fingerprints within 3 bits are linked,
    and ``component_id`` is the smallest key that links lead to. Texts that are null or have no words have fingerprint 0 and are linked like
    others; shorter ones are one shingle. Repeated rows give repeated rows; no rows give none; other columns play no part. Rows with a null
    key take part in links and get the smallest key of the others, null if there is none.
    """
    rows = stored(fingerprints(docs, key, text), "fingerprints")
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    links = components(near_links(groups.select("fp")))
    rooted = groups.join(links, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without those that a near copy stands for.

    One fingerprint of the whole text can't tell near copies by five-word shingles from others: at a resemblance of 0.8 they are about 10 bits apart and often 16,
    where trees rule nothing out. So ``resemblance`` takes many fingerprints of sampled shingles, searches the trees for each, and checks what meets on the sets.
    """
    return resemblance.one_of_each(docs, key, text)
