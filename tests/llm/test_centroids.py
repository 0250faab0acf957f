"""Clusters against a plain restatement with Python's integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from gaugeline.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(int(x) * 1024 if abs(x) > 1e9 else 1024 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    places = [p for _, p in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), n) for n, c in enumerate(places))
    for _ in range(rounds):
        own = [near(p)[1] for _, p in kept]
        for n in range(len(places)):
            if some := [p for (_, p), c in zip(kept, own, strict=True) if c == n]:
                places[n] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    found = [(i, *near(p)) for i, p in kept]
    by = Counter()
    for _, d, n in found:
        by[n] += d
    return Counter((i, n, d, by[n], sum(by.values()), hashlib.sha256(",".join(map(str, places[n])).encode()).hexdigest()) for i, d, n in found)


def vectors(n, seed=1, spread=0.3):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    return [(i, [f(r.gauss((i % 11) / 10 - 0.5 if k < 20 else 0, spread * (k % 7 + 1) / 7)) for k in range(64)], 0) for i in range(n)]


def odd_vectors():
    rows = vectors(240)
    rows[5] = (5, None, 0)
    rows[6] = (6, rows[6][1][:63], 0)
    rows[7] = (7, [*rows[7][1][:63], None], 0)
    rows[8] = (8, [*rows[8][1][:63], float("nan")], 0)
    rows[9] = (9, [*rows[9][1][:63], float("-inf")], 0)
    rows[10] = (10, [], 0)
    return [*rows, rows[20], rows[20], (21, rows[22][1], 1), (None, rows[23][1], 1), (400, [0.0] * 64, None), (401, [-0.0] * 64, None)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS cluster", "'y' AS distance", "'z' AS x")
    got = centroids.cluster(df, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(map(tuple, got.collect()))


def test_clusters_are_exact(spark):
    assert run(spark, odd_vectors()) == brute(odd_vectors())


def test_ties_go_to_the_smaller_number(spark):
    """Equal vectors make equal centroids, all vectors of which go to the first; the others stay where they are."""
    rows = [(i, [0.5] * 64, 0) for i in range(12)] + [(20 + i, [-0.5] * 64, 0) for i in range(3)]
    got = run(spark, rows, rounds=2)
    assert got == brute(rows, rounds=2) and len({r[1] for r in got}) <= 2


def test_few_vectors_and_none(spark):
    rows = vectors(3)
    assert run(spark, rows) == brute(rows)
    assert not run(spark, []) and not run(spark, [(1, None, 0)])


def test_huge_components_are_exact(spark):
    """Components far beyond what squares fit in 64 bits; each such vector is a centroid of its own, at distance 0."""
    rows = vectors(40)
    starts = sorted(range(40), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    for i, x in zip(starts, (-1e25, 1e30), strict=False):
        rows[i] = (i, [float(np.float32(x)), *rows[i][1][1:]], 0)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("far", [None, 1 << 28, 1 << 40])
def test_search_finds_what_whole_distances_find(far):
    r = np.random.default_rng(2)
    points, places = r.integers(-900, 900, (500, 64)), r.integers(-900, 900, (8, 64)).tolist()
    places[5] = places[2]
    points[7] = places[2]
    if far:
        places[1] = [far, *places[1][1:]]
    cluster, distance = centroids.nearest(points, places, np.argsort(-points.var(0)))
    want = centroids.exact(points.tolist(), places)
    assert cluster.tolist() == want[0].tolist() and distance.tolist() == want[1].tolist()


def test_limbs_add_up():
    for n in (0, 1, -1, 1 << 31, -(1 << 31), (1 << 31) - 1, 1 << 32, -(1 << 90) + 17, 3 << 70):
        assert sum(x << 32 * k for k, x in enumerate(centroids.limbs(n))) == n
    assert centroids.scaled(-0.0001) == -1 and centroids.scaled(1e30) == int(1e30) * 1024
