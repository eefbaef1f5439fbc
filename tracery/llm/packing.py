"""Best-two-fit packing of whole documents into sequences of at most `capacity` tokens.

Only lengths matter for the packing, and there are at most `capacity` of them, so the plan is made from the histogram of piece
lengths: a list of patterns (lengths that share a sequence) with multiplicities, whose size does not follow the corpus.
Pieces then find their place by their rank within their length, which needs no task to see more than a cell of ranks.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, ranked, saved, text_or_empty, text_slices
from .tokens import encoder, vocabulary_path


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """[(how many sequences, their piece lengths)], each piece used once.

    A sequence is filled greedily: the longest piece left, then again and again the longest that fits.  Then its smallest piece is
    taken out if two pieces that are left fill the gap so made more tightly, and the best two come in.  Equal sequences are made
    at once, as often as the pieces last.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] += k
    out = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        bin_, room, own = [], capacity, left.copy()
        while True:
            fits = have[: np.searchsorted(have, room, "right")]
            fits = fits[own[fits] > 0]
            if not len(fits):
                break
            n = int(fits[-1])
            bin_.append(n)
            own[n] -= 1
            room -= n
        if room and len(bin_) > 1:
            gap = room + bin_[-1]
            small = np.flatnonzero(own[: gap + 1])
            if len(small):
                # for each first piece, the longest second one that fits beside it
                second = np.searchsorted(small, gap - small, "right") - 1
                second = np.where((second >= 0) & (small[second] == small) & (own[small] < 2), second - 1, second)
                total = np.where(second >= 0, small + small[second], 0)
                best = int(np.argmax(total))
                if total[best] > bin_[-1] and total[best] <= gap:
                    bin_[-1:] = [int(small[second[best]]), int(small[best])]
        lengths, used = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // used).min())
        left[lengths] -= times * used
        out.append((times, sorted(bin_, reverse=True)))


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the piece of that length with rank r goes to sequence first + r - first rank."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            r = rank.get(n, 0)
            out.append((n, r, r + times, sequence, offset))
            rank[n], offset = r + times, offset + n
        sequence += times
    return out


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), array("H", [end_id]).tobytes()
        for x in batches:
            piece, start, length, crc, at = [], [], [], [], []
            for first, held in text_slices(x.column(1)):
                for i, t in enumerate(held, first):
                    ids = np.frombuffer(encode(t.decode("utf-8", "replace")) + end, "<u2").astype("<u4")
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        at.append(i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
            pa.default_memory_pool().release_unused()
            row = x.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([row, pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_cut(path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids from the vocabulary file `path` and then `end_id`; only longer ones are cut, every `capacity` ids.
    Null and empty texts are the end id alone.  Repeated rows are packed each by itself; null doc_ids too.  An empty table: no rows.
    Other columns are ignored.
    """
    cut = saved(numbered(pieces(docs, path or vocabulary_path("word_bpe_49k.json"), capacity, end_id)), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    # as an Arrow table: rows of a list would go through Python workers of another kind, which then stay beside the others
    found = np.array(places(plan(counts, capacity)), np.int64).reshape(-1, 5)
    where = docs.sparkSession.createDataFrame(pa.table(list(found.T), names=["length", "low", "high", "first", "offset"]))
    placed = ranked(cut, "length", ["doc_id", "piece", "start", "row_key"], "rank")
    here = (F.col("p.length") == F.col("w.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    out = placed.alias("p").join(F.broadcast(where).alias("w"), here)
    return out.select("doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
