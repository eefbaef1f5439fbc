"""Sharding by minimax contiguous partition of ordered atomic groups.  DataFrame functions only.

Groups are equal texts, ordered by a hash of the text.  The smallest feasible shard capacity is found by binary search with a
greedy check, over sums by ranges of the hash.  A range counts once as one indivisible group (what is feasible so, is feasible)
and once as divisible anywhere (what is not feasible so, is not): where the two answers differ, the ranges in which a cut may
fall are summed more finely, down to single groups if need be.  The driver holds a bounded number of sums; a cut is a hash, so
that rows find their shard by comparing with at most `shards` - 1 literals.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, ranked, saved, text_or_empty

#: Bits of the hash by which the first sums are taken, and by which each refinement goes on.
FIRST_BITS, MORE_BITS = 14, 8

Range = tuple[int, int, int]  # total size, least and largest hash


def greedy(ranges: list[Range], ends: list[int], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Sizes before each cut if `shards` shards of at most `capacity` hold everything, each filled as far as it goes; else None.
    A cut that cannot move on ends the list early."""
    total, at, cuts = ends[-1], 0, []
    for _ in range(shards):
        if at + capacity >= total:
            return cuts
        i = bisect_right(ends, at + capacity)
        here = ends[i - 1] if i else 0
        if divisible and ranges[i][1] < ranges[i][2]:
            here = at + capacity
        if here <= at:
            return None
        at = here
        cuts.append(at)
    return None


def smallest(ranges: list[Range], ends: list[int], shards: int, divisible: bool) -> int:
    low, high = (ends[-1] - 1) // shards, ends[-1]
    while high - low > 1:
        mid = (low + high) // 2
        if greedy(ranges, ends, mid, shards, divisible) is None:
            low = mid
        else:
            high = mid
    return high


def reach(ranges: list[Range], ends: list[int], capacity: int, shards: int, divisible: bool) -> list[int]:
    """Where the cuts come to lie, whether or not the last shard holds the rest."""
    at, cuts = 0, []
    for _ in range(shards - 1):
        i = bisect_right(ends, at + capacity)
        here = ends[-1] if i == len(ends) else ends[i - 1] if i else 0
        if i < len(ends) and divisible and ranges[i][1] < ranges[i][2]:
            here = at + capacity
        at = max(at, here)
        cuts.append(at)
    return cuts


def _sums(groups: DataFrame, shift: int) -> list[tuple[int, Range]]:
    rows = groups.groupBy(F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high")).collect()
    return sorted((r["bin"], (r["size"], r["low"], r["high"])) for r in rows)


def cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """The least hash of each shard but the first, and the smallest feasible capacity, for rows (hash, size) with size > 0."""
    shift = 64 - FIRST_BITS
    ranges = [r for _, r in _sums(groups, shift)]
    while ranges:
        ends = list(accumulate(r[0] for r in ranges))
        high, low = (smallest(ranges, ends, shards, d) for d in (False, True))
        if high == low or shift == 0:
            break
        near, far = reach(ranges, ends, low, shards, False), reach(ranges, ends, high, shards, True)
        open_ = {i for a, b in zip(near, far, strict=True) for i in range(bisect_right(ends, a), min(bisect_right(ends, b) + 1, len(ends))) if ranges[i][1] < ranges[i][2]}
        # open ranges have been open all along, so each is one bin of the finest sums so far
        wide = sorted({ranges[i][1] >> shift for i in open_})
        fine = max(0, shift - MORE_BITS)
        parts = [r for _, r in _sums(groups.where(F.shiftright("hash", shift).isin(wide)), fine)]
        ranges = sorted([r for i, r in enumerate(ranges) if i not in open_] + parts, key=lambda r: r[1])
        shift = fine
    if not ranges:
        return [], 0
    at = greedy(ranges, ends, high, shards, False) or []
    return [ranges[bisect_right(ends, c)][1] for c in at], high


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """A row for each row of `docs` (doc_id, text): doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: the largest shard is as small as contiguous shards of whole groups allow.  Equal texts share a shard, also
    when they outweigh it; null and empty texts are one group of size 1 each row.  Slots are gapless from 0 in each shard, in no
    promised order.  Repeated rows are rows of their own; null doc_ids are kept.  Fewer groups than shards leave shards
    empty; an empty table gives no rows.  Other columns are ignored.
    """
    text = text_or_empty()
    base = saved(numbered(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"))), "sizes")
    at, _ = cuts(base.select("hash", "size"), shards)
    here = sum(((F.col("hash") >= c).cast("int") for c in at), F.lit(0))
    out = ranked(base.withColumn("shard", here), "shard", ["doc_id", "row_key"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
