"""Helpers shared by the corpus operators: tables, the shared folder, and batches of text as numpy arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import saved, shared_dir  # noqa: F401

#: Texts are handled in slices of about so many bytes, so that a task's memory does not follow its partition.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str = "row_key") -> DataFrame:
    """`df` with a number of its own for each row, also of equal rows; `saved` afterwards fixes it."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ranked(df: DataFrame, by: str, order: list[str], name: str, cell_rows: int = 20_000) -> DataFrame:
    """`df` with a rank from 0 within each value of `by` (values bounded in number, none null), gapless.

    Rows are dealt into cells by a hash of `order`, numbered within the cell, and the cells' counts give where each begins.  A hot
    value has many cells: a cell holds at most about `cell_rows` rows, and at most a fraction of a task's even share.  `order` should tell equal rows apart (see `numbered`), or
    they all come to one cell.
    """
    largest, rows = df.groupBy(by).count().agg(F.max("count"), F.sum("count")).first()
    share = (rows or 0) // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    df = df.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit((largest or 0) // min(share, cell_rows) + 1)))
    counts = df.groupBy(by, "cell").count()
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select(by, "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy(by, "cell").orderBy(*order)) - 1
    return df.withColumn("inside", inside).join(begin, [by, "cell"]).withColumn(name, F.col("begin") + F.col("inside")).drop("cell", "begin", "inside")


#: Texts of a slice, so that many empty ones are bounded too.
SLICE_ROWS = 2048


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) in slices of at least one text and about `most` bytes."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and (total + len(b) > most or len(held) == SLICE_ROWS):
            yield first, held
            first, held, total = i, [], 0
        held.append(b)
        total += len(b)
    if held:
        yield first, held


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """`slices` of an Arrow column of strings: only one slice's texts are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    raw, first, total = column.cast(pa.large_binary()), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (total + n > most or i - first == SLICE_ROWS):
            yield first, [t or b"" for t in raw[first:i].to_pylist()]
            first, total = i, 0
        total += n
    if len(sizes):
        yield first, [t or b"" for t in raw[first:].to_pylist()]


def appended(docs: DataFrame, keep: list[str], name: str, score: Callable[[list[bytes], pa.RecordBatch], np.ndarray], reads: tuple[str, ...] = (), most: int = SLICE_BYTES) -> DataFrame:
    """The columns `keep` of `docs`, and `name`: the doubles that `score` makes of a slice's texts and rows.  The text is carried once, and a slice
    of about `most` bytes is scored at a time."""
    fields = {f.name: f for f in docs.schema.fields}
    columns = list(dict.fromkeys([*keep, "text", *reads]))
    text_at, kept = columns.index("text"), [columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, held in text_slices(x.column(text_at), most):
                part = x.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(score(held, part), pa.float64())], names=[*keep, name])

    schema = T.StructType([*(fields[c] for c in keep), T.StructField(name, T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, docs: int, most: Callable[[object], int], kind: Callable[[object], object], label: Callable[[object], object], tag: str) -> list:
    """`bounded` of the first `docs` rows with a `text`, in the order of a hash of doc_id: which rows are taken is decided by the lengths, and only
    their texts come to the driver."""
    rows = saved(rows.withColumns({"key": F.monotonically_increasing_id(), "size": F.length("text").cast("long"), "hash": F.xxhash64("doc_id"), "of_text": F.xxhash64("text")}), tag)
    few = rows.drop("text").orderBy("hash", "doc_id", "of_text", "key").limit(docs).collect()
    taken = [r["key"] for r in bounded(few, most, lambda r: r["size"], kind, label)]
    texts = {r["key"]: r for r in rows.where(F.col("key").isin(taken)).toLocalIterator()}
    return [texts[k] for k in taken]


_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        a = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        a[0] = 1
        _powers[base] = np.multiply.accumulate(a)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_table(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to words."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


def hashed_words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a slice, and for each text the number of words before it (one more at the end).

    `\\n` must be a separator.  A word's hash is a polynomial over its bytes, from prefix sums over the whole slice.
    """
    buf = b"\n" + b"\n".join(texts) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    edge = np.diff(is_word[a].view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    sums = np.cumsum(_BYTE[a] * _power(_P, len(a)), dtype=np.uint64)
    h = (sums[ends - 1] - sums[starts - 1]) * _power(_P_INVERSE, len(a))[starts]
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, begin)


def bounded(rows: Iterable, most: Callable[[object], int], length: Callable[[object], int], kind: Callable[[object], object], label: Callable[[object], object]) -> list:
    """Rows in their order as long as they fit: each kind has a sum of lengths of at most most(kind).  One that doesn't fit is skipped and counts nothing, one of over a
    tenth of it waits until the others are taken, and each label has one row at least."""
    out, late, size, held, waiting = [], [], defaultdict(int), defaultdict(int), set()
    for r in rows:
        k, n = kind(r), length(r)
        if 10 * n > most(k):
            if held[k] + n <= most(k) or label(r) not in waiting:
                late.append(r)
                held[k] += n
                waiting.add(label(r))
        elif size[k] + n <= most(k):
            out.append(r)
            size[k] += n
    there = {label(r) for r in out}
    for r in late:
        k, n = kind(r), length(r)
        if size[k] + n <= most(k) or label(r) not in there:
            out.append(r)
            size[k] += n
            there.add(label(r))
    return out
