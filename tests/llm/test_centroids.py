"""Delta Lloyd against plain Lloyd in Python integers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracery.llm import centroids

VECTORS = "vec_id long, embedding array<float>"
rng = random.Random(6)


def plain(rows, k, rounds, dim, scale=256):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row."""
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in good]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        owners = [j for _, j in assign()]
        for j in set(owners):
            own = [v for (_, v), o in zip(kept, owners, strict=True) if o == j]
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = assign()
    inertia, of = sum(d for d, _ in last), Counter()
    for d, j in last:
        of[j] += d
    return sorted(((i, j, d, of[j], inertia, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def vectors(n, dim, spread=0.3):
    return [(i, [rng.choice([-1, 0, 1]) + rng.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


def got(df):
    return sorted((tuple(r) for r in centroids.digest(df).collect()), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(1, 3), (7, 0), (7, 5), (40, 5), (500, 2)])
def test_against_plain_lloyd(spark, k, rounds):
    rows = vectors(200, 6)
    rows += [(900, rows[0][1]), (901, rows[0][1]), rows[5], rows[5]]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert got(centroids.delta_lloyd(df, k=k, rounds=rounds, dim=6)) == plain(rows, k, rounds, 6)


def test_odd_vectors(spark):
    rows = [*vectors(50, 4), (None, [0.1, 0.2, 0.3, 0.4]), (60, None), (61, [0.0] * 3), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan")] * 4), (64, [float("-inf"), 0.0, 0.0, 0.0]), (65, [])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("owner", "cluster", "distance", "v", "was", "label", "key")})
    assert got(centroids.delta_lloyd(df, k=5, rounds=4, dim=4)) == plain(rows, 5, 4, 4)


def test_more_clusters_than_vectors_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    assert got(centroids.delta_lloyd(spark.createDataFrame(rows, VECTORS), k=9, dim=2)) == plain(rows, 9, 5, 2)
    for none in ([], [(1, None)]):
        empty = centroids.delta_lloyd(spark.createDataFrame(none, VECTORS))
        assert centroids.digest(empty).count() == 0 and len(empty.centroids) == 0


def test_large_integers_are_exact_or_refused(spark):
    rows = [(i, [500_000.0 - i, -500_000.0 + 3 * i]) for i in range(12)]
    assert got(centroids.delta_lloyd(spark.createDataFrame(rows, VECTORS), k=3, dim=2)) == plain(rows, 3, 5, 2)
    with pytest.raises(ValueError, match="too large"):
        centroids.delta_lloyd(spark.createDataFrame([(1, [1e9, 0.0])], VECTORS), dim=2)


def test_sums_follow_the_transfers(spark):
    found = centroids.delta_lloyd(spark.createDataFrame(vectors(150, 3), VECTORS), k=6, dim=3)
    assert found.counts.tolist() == [found.assigned.where(F.col("owner") == j).count() for j in range(6)]


def test_only_changed_centroids_are_compared(monkeypatch):
    r = np.random.default_rng(0)
    v, c = r.integers(-99, 99, (300, 5)), r.integers(-99, 99, (12, 5))
    d = centroids.distances(v, c)
    owner, distance = d.argmin(axis=1), d.min(axis=1)
    c2, changed = c.copy(), np.array([2, 9])
    c2[changed] += 7
    pairs, compare = [], centroids.distances
    monkeypatch.setattr(centroids, "distances", lambda a, b: pairs.append(len(a) * len(b)) or compare(a, b))
    o, dist = centroids.reassigned(v, owner, distance, c2, changed)
    after = compare(v, c2)
    assert (o == after.argmin(axis=1)).all() and (dist == after.min(axis=1)).all()
    moved = int(np.isin(owner, changed).sum())
    assert sum(pairs) == moved * 12 + (300 - moved) * 2
