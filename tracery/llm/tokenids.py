"""Token-ID output: documents packed best-fit-decreasing into id matrices.

Each partition packs its own documents, with no shuffle: texts become ids, pieces are held until a window of `window` tokens is
full, and the window is packed by decreasing length into the fullest sequence that still has room, found in a segment tree over
the capacities left.  The matrices are written to the shared folder, and read back from there.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_slices
from .tokens import encoder, vocabulary_path

SCHEMA = "matrix string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, starts array<long>"


class Rooms:
    """Sequences by the room left in them, in a segment tree over the rooms 0..capacity that counts the sequences of each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.own: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int, by: int = 1) -> None:
        if by > 0:
            self.own[room].append(sequence)
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> int | None:
        """A sequence with the least room >= need."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.own[room].pop()
        self.add(room, sequence, -1)
        return sequence


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of piece indices; each length is at most `capacity`."""
    rooms, out, used = Rooms(capacity), [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        s = rooms.take(lengths[i])
        if s is None:
            s = len(out)
            out.append([])
            used.append(0)
        out[s].append(i)
        used[s] += lengths[i]
        if used[s] < capacity:
            rooms.add(capacity - used[s], s)
    return out


def _write(path: str, capacity: int, end_id: int, window: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), array("H", [end_id]).tobytes()
        held: list[tuple[object, int, bytes]] = []
        tokens, written, task = 0, 0, TaskContext.get().partitionId()

        def rows() -> pa.RecordBatch:
            out: dict[str, list] = {k: [] for k in ("matrix", "row", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts")}
            nonlocal written
            name, written = f"{task:06d}-{written:06d}", written + 1
            for row, own in enumerate(best_fit_decreasing([len(p[2]) // 2 for p in held], capacity)):
                parts = [held[i] for i in own]
                cu = np.cumsum([0] + [len(p[2]) // 2 for p in parts])
                ids = np.frombuffer(b"".join(p[2] for p in parts).ljust(2 * capacity, b"\0"), "<u2")
                where = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
                for k, v in zip(out, (name, row, int(cu[-1]), ids.tobytes(), cu.tolist(), where.astype("<u2").tobytes(), [p[0] for p in parts], [p[1] for p in parts]), strict=True):
                    out[k].append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(kind), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

        for x in batches:
            docs = x.column(0).to_pylist()
            for first, texts in text_slices(x.column(1)):
                for doc, text in zip(docs[first : first + len(texts)], texts, strict=True):
                    ids = encode(text.decode()) + end
                    for k in range(0, len(ids), 2 * capacity):
                        held.append((doc, k // 2, ids[k : k + 2 * capacity]))
                        tokens += len(held[-1][2]) // 2
                        if tokens >= window:
                            yield rows()
                            held.clear()
                            tokens = 0
        if held:
            yield rows()

    return run


def matrices(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 50256, window: int = 1 << 21) -> DataFrame:
    """Rows of id matrices of `docs` (doc_id, text): matrix (a name, of no other one), row, n_tokens, ids (`capacity` little-endian 16-bit ids, zeros after the
    n_tokens), cu_seqlens (where the segments begin, and the end), position_ids (16-bit, back to 0 at each segment), doc_ids and
    starts (of each segment: its document and how many of its ids came before).

    A document is its ids from the vocabulary file `path` and `end_id`; longer ones are cut losslessly every `capacity` ids, so joining a document's
    segments by start gives its ids.  A very long text's segments may lie in several matrices.  Null and empty texts are the end id alone.  Repeated rows and null doc_ids are packed
    like others.  Other columns are ignored.  An empty table: no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(_write(path or vocabulary_path("byte_bpe_50k.tiktoken"), capacity, end_id, window, to_arrow_type(field)), SCHEMA.format(kind=field.simpleString()))


def write_matrices(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 50256, window: int = 1 << 21) -> DataFrame:
    """`matrices` written as Parquet into the shared folder, as they are read back from there."""
    return saved(matrices(docs, path, capacity, end_id, window), "matrices")


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids) of each segment: the inverse of `matrices`."""
    one = rows.select("ids", "cu_seqlens", F.posexplode("doc_ids").alias("k", "doc_id"), "starts")
    low, high = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    return one.select("doc_id", F.element_at("starts", F.col("k") + 1).alias("start"), (high - low).alias("length"), F.col("ids").substr(2 * low + 1, 2 * (high - low)).alias("ids"))


def digest(rows: DataFrame) -> DataFrame:
    """The matrices with their binary columns as checksums."""
    return rows.select("matrix", "row", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", F.crc32("position_ids").alias("positions_crc32"), "doc_ids", "starts")
