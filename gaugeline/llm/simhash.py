"""SimHash near-duplicates with a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints meet in groups that agree
on a third of the bits: two of them that differ in at most two bits agree on at least one third. A group
with too many is split by thirds of its free bits, again and again, so no group is left that one task
can't hold, and no link is lost. Within a group fingerprints stand in Gray order, where neighbours
differ in few bits; upper nodes of the index hold the bits that all below them share, and a search adds
up the differences to those on its way down and leaves whole groups once they exceed the limit. Each
group gives a star for each of its components; the stars are joined to components over all documents by
taking the least label of neighbours and jumping to that label's own, which doubles the reach each round.

Defined results: a null text and one without words have fingerprint zero, linked like any other. A
component's id is its smallest doc_id that isn't null (null if it has none). Repeated rows come out as
often as they went in. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._common import map_columns, row_key, written

SEED = 42
ALL = (1 << 64) - 1
#: Groups of up to so many are compared row by row; above, the index is used.
SMALL, FANOUT = 24, 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each document."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in batches:
            yield [ids, [signed(fingerprint(t, shingle)) for t in texts]]

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def keyed_fingerprints(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """As fingerprints(), with the column __row, which tells rows of one id apart."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, rows, texts in batches:
            yield [ids, rows, [signed(fingerprint(t, shingle)) for t in texts]]

    return map_columns(docs.select(F.col("doc_id").cast("long"), "__row", "text"), run, "doc_id long, __row long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern among all patterns in Gray order, as a signed long."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def thirds(mask: int, parts: int) -> list[int]:
    """mask with each of ``parts`` parts of its free bits, highest first, set in turn."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; a node has the bits that all below it share."""

    def __init__(self, sorted_fps: np.ndarray):
        self.fps = sorted_fps
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # value and mask of shared bits, from below
        low, high = sorted_fps, sorted_fps
        while len(low) > FANOUT:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((low, ~(low ^ high)))

    def near(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of queries, of fingerprints) of all pairs that differ in at most ``most`` bits."""
        top = self.levels[-1][0] if self.levels else self.fps
        q, node = np.repeat(np.arange(len(queries)), len(top)), np.tile(np.arange(len(top)), len(queries))
        gone, seen = np.zeros(len(q), np.uint8), np.zeros(len(q), np.uint64)
        for level in range(len(self.levels) - 1, -1, -1):
            value, mask = self.levels[level]
            gone = gone + np.bitwise_count((queries[q] ^ value[node]) & mask[node] & ~seen)
            held = gone <= most
            q, gone, seen, node = (np.repeat(x[held], FANOUT) for x in (q, gone, mask[node], node))
            node = node * FANOUT + np.tile(np.arange(FANOUT), len(node) // FANOUT)
            real = node < (len(self.levels[level - 1][0]) if level else len(self.fps))
            q, gone, seen, node = q[real], gone[real], seen[real], node[real]
        gone = gone + np.bitwise_count((queries[q] ^ self.fps[node]) & ~seen)
        held = gone <= most
        return q[held], node[held]


def united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least position of its component) after the links a-b are added."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (jumped := labels[labels] < labels).any():
            labels[jumped] = labels[labels[jumped]]
    return labels


def stars(fps: np.ndarray, groups: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from, to) that join what is linked within each run of equal ``groups``; fps in Gray order in each."""
    labels = np.arange(len(fps))
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(fps)])
    small = np.repeat(sizes <= SMALL, sizes)
    for gap in range(1, min(SMALL, sizes.max(initial=0))):
        at = np.flatnonzero(small[gap:] & (groups[gap:] == groups[:-gap]))
        at = at[np.bitwise_count(fps[at] ^ fps[at + gap]) <= most]
        labels = united(labels, at, at + gap)
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        own = fps[start : start + size]
        index = GrayIndex(own)
        for at in range(0, size, 256):
            q, found = index.near(own[at : at + 256], most)
            labels = united(labels, q + at + start, found + start)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return moved, labels[moved]


def _links(sorted_rows: DataFrame, most: int) -> DataFrame:
    """Stars of each group. Rows are (mask, key, fp), whole groups together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of groups that may go on

        def out(parts: list[tuple[np.ndarray, ...]], last: bool) -> pa.RecordBatch | None:
            mask, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            change = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
            end = len(fp) if last else np.flatnonzero(change)[-1]
            held[:] = [] if last else [(mask[end:], key[end:], fp[end:])]
            if not end:
                return None
            a, b = stars(fp[:end].view(np.uint64), np.cumsum(change[:end]), most)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                if len(held) == 1 or (held[0][0][0], held[0][1][0]) != (held[-1][0][-1], held[-1][1][-1]):
                    if (got := out(held, False)) is not None:
                        yield got
        if held and (got := out(held, True)) is not None:
            yield got

    return sorted_rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, *, most: int = 2, group_rows: int = 4096, levels: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp, enough to join all that differ in at most ``most`` bits.

    A group of more than ``group_rows`` is split by parts of its free bits. After four splits of 64 bits into
    thirds at most 13 bits are free, so a group then has 8,192 fingerprints at most, whatever the input."""
    masks = thirds(0, most + 1)
    rows = fps.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    leaves: list[DataFrame] = []
    for level in range(1, levels + 1):
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        if level == levels:
            leaves.append(rows)
            break
        large = written(rows.groupBy("mask", "key").count().where(F.col("count") > group_rows).select("mask", "key"), f"large{level}")
        if large.isEmpty():
            leaves.append(rows)
            break
        leaves.append(rows.join(large, ["mask", "key"], "left_anti").select("mask", "key", "fp"))
        below = F.create_map(*(x for m in masks for x in (F.lit(signed(m)), F.array(*(F.lit(signed(c)) for c in thirds(m, most + 1))))))
        # Two masks can have a part of their free bits in common below, hence distinct().
        rows = rows.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(below[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({c for m in masks for c in thirds(m, most + 1)})
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    return _links(every.repartition("mask", "key").sortWithinPartitions("mask", "key", gray_rank(F.col("fp"))), most)


def connected(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) for each node of the edges (a, b)."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        nearer = written(labels.join(heard, F.col("node") == F.col("a")).select("node", F.least("root", "heard").alias("root"), F.col("root").alias("was")), "nearer")
        own = nearer.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        labels = written(nearer.join(own, F.col("root") == F.col("at")).select("node", "was", F.least("root", "beyond").alias("root")), "labels")
        if labels.where("root != was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def components(docs: DataFrame, *, most: int = 2, shingle: int = 3, hot_share: float = 0.001) -> DataFrame:
    """doc_id, fp and component_id of each document.

    Fingerprints of more than ``hot_share`` of the documents, of which there are 1 / hot_share at most, are broadcast with
    their components, so documents that share one don't meet in one task."""
    own = written(fingerprints(docs, shingle=shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    roots = connected(links(distinct, most=most))
    joined = distinct.join(roots, F.col("fp") == F.col("node"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = joined.join(lows, "root").select("fp", "component_id")
    of_fp = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "n"), "components")
    total = of_fp.agg(F.sum("n")).first()[0] or 0
    hot = of_fp.where(F.col("n") > hot_share * total).select("fp", "component_id", F.lit(True).alias("hot"))
    seen = own.join(F.broadcast(hot), "fp", "left")
    rare = seen.where("hot IS NULL").drop("component_id").join(of_fp.where(F.col("n") <= hot_share * total), "fp")
    return seen.where("hot").select("doc_id", "fp", "component_id").unionByName(rare.select("doc_id", "fp", "component_id"))


def keep_first(docs: DataFrame, *, most: int = 2, shingle: int = 3) -> DataFrame:
    """One whole row of each component, that of its smallest doc_id; of rows that are alike in all columns one."""
    names = docs.columns
    keyed = docs.withColumn("__row", row_key(docs))
    own = written(keyed_fingerprints(keyed, shingle=shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")), "distinct")
    roots = connected(links(distinct, most=most))
    firsts = distinct.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    chosen = firsts.select(F.col("first.doc_id").alias("__id"), F.col("first.__row").alias("__first"))
    kept = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row"]).select(*names)
