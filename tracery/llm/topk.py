"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block.  Each round counts the scores of each query in equal bins of its open
interval; the summed histograms say in which bin its k-th highest score lies, and that bin is the next interval, until it is a single score.
A last pass keeps the scores above the k-th value, and of the ties at it those with the smallest vec_ids.  A block sends only what may
matter: bins below its own k-th score can't hold the k-th of all, nor can ties beyond its first k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

QUERY_BLOCK, ROW_BLOCK, BINS = 256, 4096, 1024
#: Inner products below this are exact in doubles.
EXACT = 2**53


def integers(embedding: str = "embedding", scale: int = 64) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Packed blocks (d, name, keys, ids, matrix) of vectors of one length: about `rows` each, dealt by a hash of the row's key."""
    n = vectors.count() // rows + 1

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        m = np.concatenate([np.asarray(v, "<i8") for v in t.column("v").combine_chunks().to_pylist()])
        packed = lambda c: pa.array([t.column(c).to_numpy().astype("<i8").tobytes()], pa.binary())
        return pa.table({"d": t.column("d")[:1], name: t.column(name)[:1], f"{name}_keys": packed("key"), f"{name}_ids": packed("vec_id"), f"{name}_matrix": pa.array([m.tobytes()], pa.binary())})

    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("key"), F.lit(n)))
    return saved(dealt.groupBy("d", name).applyInArrow(pack, f"d int, {name} long, {name}_keys binary, {name}_ids binary, {name}_matrix binary"), name)


def scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query keys, row ids, score matrix, which pairs count) of two blocks: exact int64 scores."""
    qk, rk, ri = (np.frombuffer(row[c], "<i8") for c in ("q_keys", "r_keys", "r_ids"))
    a, b = np.frombuffer(row["q_matrix"], "<i8").reshape(len(qk), row["d"]), np.frombuffer(row["r_matrix"], "<i8").reshape(len(rk), row["d"])
    wide = float(np.abs(a).astype(float).max(initial=0)) * float(np.abs(b).astype(float).max(initial=0)) * a.shape[1] < EXACT
    s = (a.astype(float) @ b.astype(float).T).astype(np.int64) if wide else a @ b.T
    return qk, ri, s, qk[:, None] != rk[None]


def _histogram(k: int):
    def run(batches):
        for x in batches:
            out = []
            for row in x.to_pylist():
                qi, _, s, counts = scores(row)
                low, width = np.frombuffer(row["low"], "<i8")[:, None], np.frombuffer(row["width"], "<i8")[:, None]
                above = counts & (s >= low + width * BINS)
                inside = counts & (s >= low) & ~above
                at = np.where(inside, np.arange(len(qi))[:, None] * BINS + (s - low) // width, len(qi) * BINS)
                h = np.bincount(at.ravel(), minlength=len(qi) * BINS + 1)[:-1].reshape(len(qi), BINS)
                over = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h + above.sum(axis=1)[:, None]
                i, b = np.nonzero((h > 0) & (over < k))
                out.append(pd.DataFrame({"query": qi[i], "bin": b, "n": h[i, b]}))
                first = np.minimum(above.sum(axis=1), k)
                j = np.flatnonzero(first)
                out.append(pd.DataFrame({"query": qi[j], "bin": np.full(len(j), BINS), "n": first[j]}))
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out).astype("int64"), preserve_index=False)

    return run


def _select(k: int):
    def run(batches):
        for x in batches:
            for row in x.to_pylist():
                qi, ri, s, counts = scores(row)
                kth = np.frombuffer(row["low"], "<i8")[:, None]
                i, j = np.nonzero(counts & (s >= kth))
                by = np.lexsort((ri[j], -s[i, j], i))
                i, j = i[by], j[by]
                first = np.searchsorted(i, np.arange(len(qi)))
                keep = np.arange(len(i)) - first[i] < k
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ri[j]), pa.array(s[i, j])], names=["query", "vec_id", "score"])

    return run


def _paired(q: DataFrame, bounds: DataFrame, r: DataFrame) -> DataFrame:
    """Each query block, with its queries' intervals in the order of its ids, against each row block: a stated query set, in blocks."""

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("query")
        return pa.table({"d": t.column("d")[:1], "q": t.column("q")[:1], "low": pa.array([t.column("low").to_numpy().astype("<i8").tobytes()], pa.binary()), "width": pa.array([t.column("width").to_numpy().astype("<i8").tobytes()], pa.binary())})

    q = q.join(bounds.groupBy("d", "q").applyInArrow(gather, "d int, q long, low binary, width binary"), ["d", "q"])
    return q.join(r.withColumnRenamed("d", "r_d").hint("shuffle_replicate_nl"), F.col("d") == F.col("r_d")).drop("r_d")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the `k` highest integer inner products with
    the other rows, ties to the smaller vec_id; all, if there are fewer.

    A component x counts as floor(`scale` * x).  Vectors that are null, or hold null or non-finite components, take no part, nor do
    null vec_ids.  Repeated vec_ids: each row is a candidate of its own, and a query of its own, for which the others are candidates.  Vectors of different lengths have no
    inner product and are no pair; those without components all have the score 0.  Other columns are ignored.  No queries or an empty table: no rows.
    """
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.where(good & F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("d"), integers("embedding", scale).alias("v"))
    v = saved(v, "vectors")  # each row's key is fixed by the writing
    asked = v.where(F.col("vec_id") % every == 0)
    r, q = _blocks(v, ROW_BLOCK, "r"), _blocks(asked, QUERY_BLOCK, "q")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    longest = v.agg(F.max(norm)).first()[0] or 0.0
    n = asked.count() // QUERY_BLOCK + 1
    reach = F.ceil(norm * longest * (1 + 1e-9)).cast("long") + 1
    bounds = asked.select("d", F.pmod(F.xxhash64("key"), F.lit(n)).alias("q"), F.col("key").alias("query"), "vec_id", (-reach).alias("low"), (F.floor((2 * reach) / F.lit(BINS)) + 1).cast("long").alias("width"))
    bounds = saved(bounds, "bounds")
    while True:
        found = _paired(q, bounds, r).mapInArrow(_histogram(k), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("over", F.coalesce(F.sum("n").over(down), F.lit(0)))
        # the bin of the k-th score; with fewer than k scores, the lowest one
        at = found.where(F.col("over") < k).groupBy("query").agg(F.min("bin").alias("bin"))
        new = bounds.join(at, "query", "left").withColumn("at", F.coalesce("bin", F.lit(0)))
        low = F.col("low") + F.col("at") * F.col("width")
        new = new.select("d", "q", "query", "vec_id", low.alias("low"), (F.floor((F.col("width") - 1) / F.lit(BINS)) + 1).cast("long").alias("next"), "width")
        last = (bounds.agg(F.max("width")).first()[0] or 1) == 1
        bounds = saved(new.select("d", "q", "query", "vec_id", "low", F.col("next").alias("width")), "bounds")
        if last:
            break
    best = _paired(q, bounds, r).mapInArrow(_select(k), "query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(bounds.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
