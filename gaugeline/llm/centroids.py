"""Centroid clustering with exact integers and partial-distance search.

Vectors of 64 finite components are scaled and floored to integers. Each round assigns every vector to its nearest
centroid, then moves each centroid to the floor of its vectors' mean; the last assignment has no move after it.
A vector's squared distance is added up over the dimensions of most variance first, some at a time: the centroid that is
nearest by the first of them is worked out whole, and each other one is left as soon as its sum is strictly above the best
so far. What survives all dimensions is compared exactly, the smaller number first among equals. All this is done for
the rows of a batch together. Tasks hand out one row of sums for each centroid, as limbs of 32 bits that can't overflow, so
the driver gets a few hundred numbers a round, however many vectors there are; the vectors are written once and read
again each round.

Defined results: vectors that are null, of another length, or hold a null or a component that isn't finite take no part
and have no row. Repeated rows count each for itself. First centroids are the rows least by the hash of their vec_id, rows
of one hash by their components; a null vec_id comes after all others. With fewer vectors than centroids each is one, and of no
vectors there are no rows. Components of any finite size are exact; only a returned distance beyond 64 bits raises. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm._common import written

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
SLICE = 8  # dimensions that are added before rows are left
#: Components below SMALL can't overflow 64 bits; one above FAR is above any distance among small ones by itself.
SMALL, FAR = 1 << 26, 1 << 32


def scaled(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exactly."""
    top, bottom = x.as_integer_ratio()
    return scale * top // bottom


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and x, the components as doubles, of the vectors that take part."""
    x = F.col("x")
    whole = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where((F.size(x) == dimensions) & whole)


def nearest(points: np.ndarray, centroids: list[list[int]], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each point's nearest centroid, and the squared distance. points: int64, all below SMALL.

    centroids that are neither small nor far, or no small one at all, make it fall back to whole exact distances."""
    small = [k for k, c in enumerate(centroids) if max(map(abs, c)) < SMALL]
    if not small or any(k not in small and max(map(abs, c)) < FAR for k, c in enumerate(centroids)):
        return exact(points.tolist(), centroids)
    near = np.array([centroids[k] for k in small], np.int64)[:, order]
    number, points = np.array(small), points[:, order]
    first = ((points[:, None, :SLICE] - near[None, :, :SLICE]) ** 2).sum(2)
    best_at = first.argmin(1)
    best = ((points - near[best_at]) ** 2).sum(1)
    cluster = number[best_at]
    for k in range(len(small)):
        rows = np.flatnonzero((best_at != k) & (first[:, k] <= best))
        so_far = first[rows, k]
        for at in range(SLICE, points.shape[1], SLICE):
            so_far = so_far + ((points[rows, at : at + SLICE] - near[k, at : at + SLICE]) ** 2).sum(1)
            held = so_far <= best[rows]
            rows, so_far = rows[held], so_far[held]
        won = (so_far < best[rows]) | (number[k] < cluster[rows])
        rows = rows[won]
        best[rows], cluster[rows] = so_far[won], number[k]
    return cluster, best


def exact(points: list[list[int]], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """As nearest(), for integers of any size."""
    found = [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(centroids)) for p in points]
    return np.array([k for _, k in found], np.int64), np.array([d for d, _ in found], object)


def parts(batch: pa.RecordBatch, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray]:
    """The small points of a batch with their rows, and the others, as integers of any size, with theirs."""
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    small = (np.abs(x) < SMALL // scale).all(1)
    return np.floor(x[small] * scale).astype(np.int64), np.flatnonzero(small), [[scaled(v, scale) for v in row] for row in x[~small].tolist()], np.flatnonzero(~small)


def limbs(n: int) -> list[int]:
    """n in parts of 32 bits, lowest first; all but the last are positive."""
    out = []
    while not -(1 << 31) <= n < 1 << 31:
        out.append(n & 0xFFFFFFFF)
        n >>= 32
    return [*out, n]


def sums_of(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray, dimensions: int, scale: int) -> list[list[int]]:
    """For each centroid the sums of its vectors in each dimension, and last how many they are."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order = shared.value
        total = [[0] * (dimensions + 1) for _ in centroids]
        for batch in batches:
            points, _, large, _ = parts(batch, dimensions, scale)
            if len(points):
                cluster, _ = nearest(points, centroids, order)
                for k in np.unique(cluster).tolist():
                    own = points[cluster == k]
                    total[k] = [a + b for a, b in zip(total[k], [*own.sum(0).tolist(), len(own)], strict=True)]
            for k, p in zip(exact(large, centroids)[0].tolist(), large, strict=True):
                total[k] = [a + b for a, b in zip(total[k], [*p, 1], strict=True)]
        rows = [(k, at, level, limb) for k, sums in enumerate(total) if sums[-1] for at, n in enumerate(sums) for level, limb in enumerate(limbs(n))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["cluster", "at", "level", "limb"])

    each = vectors.mapInArrow(run, "cluster long, at long, level long, limb long")
    totals = [[0] * (dimensions + 1) for _ in centroids]
    for r in each.groupBy("cluster", "at", "level").agg(F.sum("limb").alias("limb")).collect():
        totals[r.cluster][r["at"]] += r.limb << 32 * r.level
    return totals


def by_variance(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """The dimensions by falling variance, as doubles tell it; the order makes the search short and changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, dimensions))
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                sums += [np.full(dimensions, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions, dtype=np.int32)), *map(pa.array, sums)], ["at", "n", "s", "ss"])

    spread = F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)
    rows = vectors.select("x").mapInArrow(run, "at int, n double, s double, ss double").where("n > 0").groupBy("at").agg(spread.alias("v")).collect()
    found = {r["at"]: r.v for r in rows if r.v is not None and r.v == r.v}  # noqa: PLR0124
    return np.array(sorted(range(dimensions), key=lambda k: (-found.get(k, 0.0), k)))


def fitted(vectors: DataFrame, *, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[list[list[int]], np.ndarray]:
    """The centroids after all rounds, and the dimensions by falling variance. vectors: as of kept_vectors(), written."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(F.asc_nulls_last(rank), "x").limit(centroids).collect()
    places = [[scaled(v, scale) for v in r.x] for r in first]
    order = by_variance(vectors, dimensions)
    for _ in range(rounds if places else 0):
        for k, (*sums, n) in enumerate(sums_of(vectors, places, order, dimensions, scale)):
            if n:
                places[k] = [s // n for s in sums]
    return places, order


def assigned(vectors: DataFrame, places: list[list[int]], order: np.ndarray, *, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast((places, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, order = shared.value
        for batch in batches:
            points, at, large, others = parts(batch, dimensions, scale)
            cluster, distance = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, object)
            if len(at):
                cluster[at], distance[at] = nearest(points, places, order)
            if len(others):
                cluster[others], distance[others] = exact(large, places)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, *, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    own = written(kept_vectors(vectors), "vectors")
    places, order = fitted(own, centroids=centroids, rounds=rounds, seed=seed)
    found = written(assigned(own, places, order), "assigned")
    told = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(places)], "cluster int, centroid_sha256 string")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    about = by_cluster.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())).join(F.broadcast(told), "cluster")  # a row for each centroid
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in DuckDB's SQL: each round is an assignment and a move."""
    near = "SELECT vec_id, e, min([d, k]) AS dk FROM (SELECT v.vec_id, v.e, v.n, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c} AS c) AS p GROUP BY n, vec_id, e"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::BIGINT AS k, e FROM v QUALIFY k < {centroids})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        if r < rounds:
            sums = f"SELECT dk[2] AS k, i, sum(e[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {DIMENSIONS + 1}) AS t(i) GROUP BY ALL"
            moved = f"SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM ({sums}) AS s GROUP BY k"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{r} AS c LEFT JOIN ({moved}) AS m USING (k))")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, dk[2]::INTEGER AS cluster, dk[1] AS distance, (sum(dk[1]) OVER (PARTITION BY dk[2]))::BIGINT AS cluster_inertia, (sum(dk[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} AS c ON c.k = dk[2]"""


ORACLE = oracle()
