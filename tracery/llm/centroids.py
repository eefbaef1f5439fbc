"""Centroid clustering by delta Lloyd, in exact integers.

Each vector's owner and its distance are kept in a written table, and so are, on the driver, the sum and number of each cluster's vectors.  A
round looks at the centroids that changed: a vector whose own centroid stood still is compared with the changed ones alone, since none of the
others came nearer; a vector whose owner moved is compared with all.  Vectors that change their cluster are transfers: taken
from one sum with a minus and put to the other with a plus, added up before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

CLUSTERS, ROUNDS, DIM, SCALE, SALT = 40, 5, 64, 256, "2:"
#: Integers of at most this size have squared distances of up to 64 components that fit 64 bits.
MOST = 1 << 27
#: Sums of products below this are exact in doubles.
EXACT = 2**53
STATE = "vec_id long, v array<bigint>, was int, owner int, distance long"


@dataclass
class Clusters:
    """`assigned` (vec_id, v, owner, distance) in the shared folder, and the final centroids and their clusters' counts."""

    assigned: DataFrame
    centroids: np.ndarray
    counts: np.ndarray


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of `v` to all rows of `c`."""
    reach = float(max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)))
    if reach * reach * v.shape[1] < EXACT:
        dot = (v.astype(float) @ c.astype(float).T).astype(np.int64)
    else:
        dot = v @ c.T
    return (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * dot


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, c: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances against the centroids `c`, of which only `changed` differ from those that `owner` and `distance` were found with.
    An owner of -1 is none yet.  Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    moved = np.zeros(len(c) + 1, bool)
    moved[changed] = moved[-1] = True
    anew = moved[owner]
    if anew.any():
        d = distances(v[anew], c)
        owner[anew] = d.argmin(axis=1)
        distance[anew] = d.min(axis=1)
    rest = np.flatnonzero(~anew)
    if len(rest) and len(changed):
        d = distances(v[rest], c[changed])
        best, least = changed[d.argmin(axis=1)], d.min(axis=1)
        better = (least < distance[rest]) | ((least == distance[rest]) & (best < owner[rest]))
        owner[rest[better]], distance[rest[better]] = best[better], least[better]
    return owner, distance


def _round(c: np.ndarray, changed: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, c.shape[1])
            was, distance = x.column(3).to_numpy(), x.column(4).to_numpy()
            owner, distance = reassigned(v, was, distance, c, changed)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(3), pa.array(owner, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "was", "owner", "distance"])

    return run


def _transfers(state: DataFrame, dim: int) -> list:
    """A row for each cluster that won or lost vectors: signed number and signed componentwise sum.  Tasks add up their own before the shuffle."""
    sides = F.array(F.struct(F.col("owner").alias("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")))
    signed = state.where("owner <> was").select("v", F.explode(sides).alias("side")).where("side.cluster >= 0")
    sums = [F.sum(F.col("side.sign") * F.col("v")[i]).alias(f"c{i}") for i in range(dim)]
    return signed.groupBy("side.cluster").agg(F.sum("side.sign").alias("n"), *sums).collect()


def delta_lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> Clusters:
    """Clusters of the vectors (vec_id, embedding) with `dim` components, none null or non-finite; a component x counts as floor(`scale` * x).

    The first centroids are the `k` vectors with the smallest lowercase-hex sha256 of `salt` and vec_id, in that order (all, if there are fewer).  Each of `rounds`
    rounds assigns every vector to the nearest centroid and sets each centroid that owns vectors to the floor of their mean; then vectors are assigned once more.
    Ties go to the smaller number.  Repeated rows are vectors of their own, and as first centroids ordered by their components; a vector without a vec_id is clustered but comes
    after all others as a first centroid.  An empty table has no rows and no centroids.  Other columns are ignored.
    Integers of 2**27 or more don't fit 64-bit distances: a ValueError.
    """
    x = F.col("embedding")
    good = (F.size(x) == dim) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    none = [F.lit(-1).alias("was"), F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance")]
    state = saved(vectors.where(x.isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *none), "vectors")
    if state.where(F.exists("v", lambda e: (e >= MOST) | (e <= -MOST))).limit(1).count():
        raise ValueError(f"components of {MOST / scale:g} or more are too large for 64-bit distances")
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = state.orderBy(hashed.asc_nulls_last(), "v").select("v").limit(k).collect()
    c = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    sums, counts, changed = np.zeros_like(c), np.zeros(len(c), np.int64), np.arange(len(c))
    for _ in range(rounds if len(c) else 0):
        state = saved(state.mapInArrow(_round(c, changed), STATE), "clusters")
        for r in _transfers(state, dim):
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] += [r[f"c{i}"] for i in range(dim)]
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
        changed, c = np.flatnonzero((new != c).any(axis=1)), new
        if not len(changed):
            break
    if len(changed):
        state = saved(state.mapInArrow(_round(c, changed), STATE), "clusters")
        for r in _transfers(state, 0):
            counts[r["cluster"]] += r["n"]
    return Clusters(state.select("vec_id", "v", "owner", "distance"), c, counts)


def digest(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    of = {r["owner"]: r["s"] for r in found.assigned.groupBy("owner").agg(F.sum("distance").alias("s")).collect()}  # at most a row for each centroid
    told = [(i, of.get(i, 0), sum(of.values()), hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for i, m in enumerate(found.centroids.tolist())]
    named = found.assigned.sparkSession.createDataFrame(told, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(named), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
