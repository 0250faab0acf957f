"""Exact top-k search by inner product over a bit-sliced index.

Components become whole numbers, floor(256 x). A block of rows is held as bitmaps, one for each dimension
and bit: the slices of the quantised attributes. A query adds the slices, each as often as its weight's
bits say, with carry-save bitmap arithmetic; the slices of the sum then give the best rows from the most
significant slice down. The lowest bits of the attributes are left out of the index; what they can add to a
score has a known bound, so all rows from the k-th best sum less that bound on are taken and their whole
scores worked out from the stored numbers. The result is exact.

Defined results: vectors that are null or hold a null or a component that isn't finite take no part, as
queries or as candidates. Vectors meet those of their own length only. Equal scores go to the smaller id;
a row without an id takes no part. Of rows with one id each is a candidate; one, with the least vector, asks;
a query's own rows are all with its id. Components of any finite size take part: blocks and queries whose sums
could leave 64 bits are worked out in Python's whole numbers, and only a returned score beyond 64 bits raises.
"""

from __future__ import annotations

import copy
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
LEFT_OUT = 2  # low bits of each attribute that the index leaves out
FAR, FEW = 1024, 64  # times the usual size of a block's rows, from which a row is far out; so many of those are scored one by one


def add_slices(slices: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The bit slices of a sum of bitmaps by weight (a power of two): full adders take three of a weight to one of
    it and one of the next, until each weight has one."""
    out: list[np.ndarray] = []
    zero = next((s[0] for s in slices.values() if s), np.zeros(0, np.uint64)) & np.uint64(0)
    weight, top = 0, max(slices, default=-1)
    while weight <= top or slices.get(weight):
        own = slices.get(weight, [])
        over = slices.setdefault(weight + 1, [])
        while len(own) > 1:
            a, b, c = own.pop(), own.pop(), own.pop() if own else None
            either = a ^ b
            if c is None:
                over.append(a & b)
                own.insert(0, either)
            else:
                over.append((a & b) | (either & c))
                own.insert(0, either ^ c)
        out.append(own[0] if own else zero)
        weight += 1
        if not slices.get(weight) and weight > top:
            break
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def best(slices: list[np.ndarray], every: np.ndarray, k: int) -> int:
    """The k-th best value of the sums (the least, if there are fewer rows), read from the top slice down."""
    sure, tied, value = 0, every, 0
    for weight in range(len(slices) - 1, -1, -1):
        ones = tied & slices[weight]
        n = count(ones)
        if sure + n >= k:
            tied, value = ones, value | 1 << weight
        else:
            sure, tied = sure + n, tied & ~slices[weight]
    return value


def at_least(slices: list[np.ndarray], every: np.ndarray, value: int) -> np.ndarray:
    """A bitmap of the rows whose sum is ``value`` or more."""
    if value <= 0:
        return every
    if value >> len(slices):
        return every & np.uint64(0)
    above, equal = every & np.uint64(0), every
    for weight in range(len(slices) - 1, -1, -1):
        if value >> weight & 1:
            equal = equal & slices[weight]
        else:
            above, equal = above | (equal & slices[weight]), equal & ~slices[weight]
    return above | equal


class SlicedBlock:
    """The index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, left_out: int = LEFT_OUT):
        self.ids, self.values, self.left_out = ids, values, left_out
        rows = len(ids)
        self.other: SlicedBlock | None = None
        self.low, self.high = int(values.min(initial=0)), int(values.max(initial=0))
        coarse = (values - self.low) >> left_out
        self.bits = int(coarse.max(initial=0)).bit_length()
        padded = np.zeros((-(-rows // 64) * 64, values.shape[1]), values.dtype)
        padded[:rows] = coarse
        pack = lambda bits: np.packbits(bits, bitorder="little").view(np.uint64)
        self.every = pack(np.arange(len(padded)) < rows)
        self.slices = [[pack((padded[:, d] >> b & 1).astype(np.uint8)) for b in range(self.bits)] for d in range(values.shape[1])]

    def wide(self) -> SlicedBlock:
        """The same block, whose scores are Python's whole numbers."""
        if self.values.dtype == object:
            return self
        if self.other is None:
            self.other = copy.copy(self)
            self.other.values = self.values.astype(object)
        return self.other

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows other than those with id ``own``.

        A negative weight counts the complement of its attribute, so all that is added is positive."""
        added: dict[int, list[np.ndarray]] = defaultdict(list)
        for d, weight in enumerate(query.tolist()):
            for place in range(abs(weight).bit_length()):
                if abs(weight) >> place & 1:
                    for b, bitmap in enumerate(self.slices[d]):
                        added[place + b].append(bitmap if weight > 0 else bitmap ^ self.every)
        sums = add_slices(added)
        rows = int(np.abs(query).sum()) * ((1 << self.left_out) - 1)  # what the bits left out can add to a score
        # One row may have the query's own id, so one more than k is asked for.
        floor = best(sums, self.every, k + 1) - (-(-rows >> self.left_out)) - 1 if sums else 0
        picked = np.flatnonzero(np.unpackbits(at_least(sums, self.every, floor).view(np.uint8), bitorder="little")) if sums else np.arange(len(self.ids))
        ids = self.ids[picked]
        scores = self.values[picked] @ query
        other = ids != own
        if (self.ids == own).sum() > 1:  # rows that share the query's id could fill the first places: look at all
            ids, scores = self.ids, self.values @ query
            other = ids != own
        ids, scores = ids[other], scores[other]
        order = np.lexsort((ids, -scores))[:k] if scores.dtype == np.int64 else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[order], scores[order]


class FewRows:
    """Rows that are scored one by one."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, whole(values).astype(object)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = (self.values @ query.astype(object)).tolist()
        order = sorted((i for i in range(len(scores)) if self.ids[i] != own), key=lambda i: (-scores[i], self.ids[i]))[:k]
        return self.ids[order], np.array([scores[i] for i in order], object)


def indexes(ids: np.ndarray, values: np.ndarray) -> list[SlicedBlock | FewRows]:
    """The index of a block's rows. Rows with a component far beyond the usual ones are set apart, as their bits would give
    every dimension of all rows as many slices."""
    most = np.abs(values.astype(np.float64)).max(1, initial=0)
    far = most > FAR * max(float(np.median(most)), 1 / SCALE)
    usual = SlicedBlock(ids[~far], whole(values[~far]))
    if not far.any():
        return [usual]
    return [usual, FewRows(ids[far], values[far]) if far.sum() <= FEW else SlicedBlock(ids[far], whole(values[far]))]


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x), as 64-bit numbers where no inner product of theirs can leave 63 bits, else as Python's."""
    wide = values.astype(np.float64)
    most = scale * (np.abs(wide).max(initial=0) + 1)
    if most * most * max(1, wide.shape[-1]) < 2.0**62:
        return np.floor(scale * wide).astype(np.int64)
    exact = np.empty(wide.shape, object)
    exact.flat = [math.floor(x * Fraction(scale)) for x in map(Fraction, wide.ravel().tolist())]
    return exact


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v and size of the rows that take part."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    infinite = F.lit(float("inf"))
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))).withColumn("size", F.size("v"))


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, block_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every`` its k best among all others.

    Rows are dealt by hash to blocks of about ``block_rows``, each once. Every block gets all queries, which stream through
    the one index that its task builds, so rows + queries x blocks are shuffled and no task holds more than a block."""
    rows = usable(vectors)
    blocks = max(1, -(-rows.count() // block_rows))
    # Each row is dealt for itself, by its place in the scan, so that equal rows don't meet in one block.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    data = rows.select("size", place.alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("size", "v")).alias("a")).select("vec_id", "a.*")
    queries = asked.select("size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one size and block come together, those of the index before those that ask."""
        now: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        index: list[SlicedBlock | FewRows] | None = None
        for batch in batches:
            sizes, at, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (sizes[1:] != sizes[:-1]) | (at[1:] != at[:-1]) | (asks[1:] != asks[:-1])])
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True) if batch.num_rows else ():
                if (here := (int(sizes[a]), int(at[a]))) != now:
                    now, held, index = here, [], None
                ids = batch.column(3).slice(a, z - a).to_numpy()
                values = batch.column(4).slice(a, z - a).flatten().to_numpy().reshape(z - a, now[0])
                if not asks[a]:
                    held.append((ids, values))
                    continue
                if index is None and held:
                    joined = np.concatenate([v for _, v in held])
                    index, held = indexes(np.concatenate([i for i, _ in held]), joined), []
                if index is None:
                    continue
                # Each query is a block of its own here: one with large components mustn't slow the others.
                for own, value in zip(ids.tolist(), values, strict=True):
                    query = whole(value)
                    found: list[tuple[int, int]] = []
                    for part in index:
                        wide = isinstance(part, SlicedBlock) and max(int(np.abs(query).max(initial=0)), 1) * max(abs(part.low), abs(part.high), 1) * max(1, now[0]) >= 1 << 62
                        found += zip(*(x.tolist() for x in (part.wide() if wide else part).top(query, own, k)), strict=True)
                    found = sorted(found, key=lambda r: (-r[1], r[0]))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["query_id", "vec_id", "score"])

    dealt = data.unionByName(queries).repartition("size", "block").sortWithinPartitions("size", "block", "asks")
    local = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    # Each task hands on k rows of a query at most, so what is merged doesn't grow with the rows.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query over embeddings in DuckDB.
ORACLE = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
