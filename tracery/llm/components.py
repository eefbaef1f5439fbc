"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) that is not the smallest of its component, with that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[u], low[v])
        np.minimum.at(new, low[v], low[u])
        new = new[new]
        while (new != (nxt := new[new])).any():
            new = nxt
        if (new == low).all():
            break
        low = new
    own = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[own], nodes[low[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        u, v = forest(x.column(0).to_numpy(), x.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def connected(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges in the first two columns (longs); a component is its smallest node.

    Each batch of edges is first reduced to a forest; then large stars (link every larger neighbour to the smallest) and
    small stars (link every smaller neighbour to the smallest) alternate until nothing changes, which takes about log(n)
    rounds.  The smallest neighbour is found by a pre-aggregated minimum and joined back; a hub's edges meet in one partition of that join, which adaptive
    execution splits where it is skewed, and never in one group of Python.  Every round is written to the shared folder.  No edges: an empty result.
    Null ends and loops are ignored.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    # edges that Python made are written first: a task that goes through Python twice has two workers, and an executor keeps them all
    e = saved(saved(e, tag).mapInArrow(_contract, "u long, v long").distinct(), tag)
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = saved(e, tag)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if before == now and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
