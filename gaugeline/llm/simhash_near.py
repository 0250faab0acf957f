"""SimHash near-duplicates at a similarity of texts: word shingles whose Jaccard similarity is 0.8 or more.

Fingerprints of such texts differ in some ten bits of 64, too many to meet by thirds of the bits as those of
``simhash`` do. So texts meet by what similar ones share, their fingerprints are searched with the same
Gray-order index at a wide limit, and exact similarity decides:
1. one pass over the texts gives each its set of shingle hashes' digest, its fingerprint and ``BANDS`` band
   keys, each made of ``ROWS`` least hashes. Only the first document of each distinct set goes on;
2. within a band's groups the Gray-order index joins fingerprints at most ``MOST`` bits apart. Components of
   these joins are bins: texts of different bins aren't similar;
3. a second pass sends the shingle sets of the texts in bins, each once, to their bin, where the index
   proposes pairs again and exact similarity links them, leaving out what is joined already;
4. a bin of more than ``BIN`` texts is dealt out in blocks, each with the same few hubs. Texts that then stand
   apart from the most of their bin meet the others by rare shingles: the shingles of a text are put into one order, those
   that few texts have first, and two texts of a similarity of 0.8 share one of the first fifth of theirs. First one
   text of each part that is joined already meets one text for each such shingle, which joins the parts of tight groups;
   then whatever is still apart meets pair by pair. Texts that share a template and little else have no such shingle in common.
So no task holds a large bin, many copies of one text don't cost their square, and no link is dropped but by
the sketches: at a similarity of 0.8 bands miss 0.003 % of pairs, fingerprints fewer, at 0.85 bands 0.00004 %.

Defined results: case is that of ASCII; a text of fewer words than a shingle is one shingle; texts without
words, null ones among them, are alike. Sets are compared by 64-bit hashes. Near-duplicates are linked in
chains. Of a group the row of the smallest doc_id that isn't null stays, of rows that are alike in all columns one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._common import map_columns, row_key, written
from gaugeline.llm.simhash import SEED, GrayIndex, connected, gray_rank, signed, stars
from gaugeline.llm.substring_dedup import _mixed, bitmap, held

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
MOST = 28  # bits of 64; at a similarity of 0.8 a pair differs in 10 bits, with a deviation of 3
BIN, BIN_SHINGLES, HUBS = 4096, 4_000_000, 32  # texts and shingles of a block
COMMON = 8  # texts of large bins; shingles that more of them have come last
LARGE = 4096  # members of a band's group, from which all are joined without a search
PARITY_BITS = 1024

_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.full(len(words) - size + 1 if words else 0, size, np.uint64)
    for k in range(size):
        out += each[k : k + len(out)] * _FACTORS[k]
    return np.unique(_mixed(out))


def digest(own: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(own.tobytes(), SEED))


def fingerprint(own: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 65_536):
        ones += np.unpackbits(own[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return signed(int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big"))


def band_keys(own: np.ndarray) -> list[int]:
    """A key for each band, made of the least hashes under its permutations."""
    if not len(own):
        return []
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(own), 512):  # products that stay in the processor's cache
        least = np.minimum(least, (own[None, at : at + 512] * _FACTORS[:, None]).min(1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys + least[k::ROWS])
    return keys.view(np.int64).tolist()


def parities(own: np.ndarray) -> np.ndarray:
    """Whether the number of hashes that fall on each bit is odd; the bits of two sets differ in no more than the sets do."""
    return np.packbits(np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=PARITY_BITS) & 1).view(np.uint64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= similarity * (len(a) + len(b) - both)


def solved(digests: list[int], fps: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join all similar sets of a bin; fps in Gray order."""
    size = np.array([len(s) for s in sets])
    bits = np.array([parities(s) for s in sets])
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index, out = GrayIndex(fps), []
    for at in range(0, len(sets), 64):
        q, found = index.near(fps[at : at + 64], MOST)
        q = q + at
        q, found = q[q < found], found[q < found]
        while (jumped := root[root] < root).any():
            root[jumped] = root[root[jumped]]
        both = size[q] + size[found]
        fits = (root[q] != root[found]) & (np.minimum(size[q], size[found]) >= similarity * np.maximum(size[q], size[found]))
        q, found, both = q[fits], found[fits], both[fits]
        apart = np.concatenate([np.bitwise_count(bits[q[k : k + 65_536]] ^ bits[found[k : k + 65_536]]).sum(1, dtype=np.int64) for k in range(0, len(q), 65_536)] or [np.zeros(0, np.int64)])
        near = apart <= both * (1 - similarity) / (1 + similarity) + 1e-9
        q, found = q[near], found[near]
        order = np.argsort(np.bitwise_count(fps[q] ^ fps[found]), kind="stable")
        for i, j in zip(q[order].tolist(), found[order].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b and alike(sets[i], sets[j], similarity):
                root[max(a, b)] = min(a, b)
                out.append((digests[i], digests[j]))
    return out


def sketched(keyed: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, __row, digest, fp, n (distinct shingles) and keys of each document."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, rows, texts in batches:
            sets = [shingles(t, shingle) for t in texts]
            yield [ids, rows, list(map(digest, sets)), list(map(fingerprint, sets)), list(map(len, sets)), list(map(band_keys, sets))]

    return map_columns(keyed.select(F.col("doc_id").cast("long"), "__row", "text"), run, "doc_id long, __row long, digest long, fp long, n long, keys array<long>")


def met(members: DataFrame) -> DataFrame:
    """Joins (a, b) of digests that share a key and whose fingerprints are near. members: key, fp, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []  # rows of keys that may go on
        hub: list[int] = []  # key and digest of a large group's first member

        def out(last: bool) -> pa.RecordBatch:
            key, fp, sets = (np.concatenate(x) for x in zip(*kept, strict=True))
            end = len(key) if last else int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])[-1]) if len(key) else 0
            a, b = [], []
            if hub and len(key) and key[0] == hub[0]:  # what is left of a large group
                more = int(np.argmin(key == hub[0])) if (key != hub[0]).any() else len(key)
                a.append(sets[:more])
                b.append(np.full(more, hub[1]))
                key, fp, sets, end = key[more:], fp[more:], sets[more:], max(0, end - more)
            if len(key) - end > LARGE:
                hub[:] = [int(key[-1]), int(sets[-1])]
                a.append(sets[end:])
                b.append(np.full(len(sets) - end, hub[1]))
                kept[:] = [(key[:0], fp[:0], sets[:0])]
            else:
                kept[:] = [(key[end:], fp[end:], sets[end:])]
            if end:
                i, j = stars(fp[:end].view(np.uint64), np.cumsum(np.r_[True, key[1:end] != key[: end - 1]]), MOST)
                a.append(sets[i])
                b.append(sets[j])
            empty = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *a])), pa.array(np.concatenate([empty, *b]))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept.append(tuple(c.to_numpy() for c in batch.columns))
                yield out(False)
        if kept:
            yield out(True)

    dealt = members.select("key", "fp", "digest").repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")), "digest")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def similar(keyed: DataFrame, distinct: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, bin_size: int = BIN) -> DataFrame:
    """Links (a, b) of digests that join all similar sets. keyed: __row, text; distinct: digest, fp, n, keys, first.__row."""
    share = keyed.sparkSession.sparkContext.broadcast
    members = distinct.select(F.explode("keys").alias("key"), "fp", "digest", "n")
    bins = connected(met(members)).select(F.col("node").alias("digest"), F.col("root").alias("bin"))
    binned = written(distinct.join(bins, "digest").select("digest", "fp", "n", "bin", F.col("first.__row").alias("__row")), "binned")
    blocks = F.greatest(F.ceil(F.count("*") / bin_size), F.ceil(F.sum("n") / BIN_SHINGLES)).cast("int")
    placed = written(binned.join(binned.groupBy("bin").agg(blocks.alias("blocks")), "bin"), "placed")
    large = placed.where("blocks > 1")
    # The hubs of a large bin are its texts of least hash, found by an aggregate of bounded size a task.
    hubs = large.groupBy("bin", "blocks", F.pmod(F.xxhash64("digest"), F.lit(HUBS)).alias("__h")).agg(F.min(F.struct(F.xxhash64("digest").alias("h"), "digest")).alias("m"))
    ways = placed.select("digest", "fp", "bin", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
    to_all = hubs.select(F.col("m.digest").alias("digest"), "bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    ways = ways.unionByName(to_all.join(placed.select("digest", "fp"), "digest").select("digest", "fp", "bin", "block")).distinct()

    def sets_of(rows: DataFrame) -> DataFrame:
        """digest and own, the shingle hashes, of the documents that stand for their set; others can be among them."""
        n = rows.count()
        first = share(bitmap(rows.select(F.col("__row").alias("key")), n))

        def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
            for ids, texts in batches:
                chosen = [shingles(t, shingle) for t, stands in zip(texts, held(first.value, np.array(ids, np.int64)).tolist(), strict=True) if stands]
                yield [list(map(digest, chosen)), [s.view(np.int64) for s in chosen]]

        return map_columns(keyed.select("__row", "text"), run, "digest long, own array<long>")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bin: tuple[int, int] | None = None
        digests: list[int] = []
        fps: list[int] = []
        sets: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            links = solved(digests, np.array(fps, np.int64).view(np.uint64), sets, similarity) if len(digests) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

        for batch in batches:
            where = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for k, (d, fp) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if where[k] != held_bin:
                    if digests:
                        yield out()
                    held_bin, digests, fps, sets = where[k], [], [], []
                if not digests or digests[-1] != d:  # of equal rows one counts
                    digests.append(d)
                    fps.append(fp)
                    sets.append(batch.column(4)[k].values.to_numpy().view(np.uint64))
        if digests:
            yield out()

    in_bins = sets_of(placed).join(ways, "digest").select("bin", "block", "digest", "fp", "own")
    dealt = in_bins.repartition("bin", "block").sortWithinPartitions("bin", "block", gray_rank(F.col("fp")), "digest")
    near = written(dealt.mapInArrow(solve, "a long, b long"), "near")
    if large.isEmpty():
        return near
    return near.union(written(across(near, large.select("digest", "fp", "n", "bin", "__row"), sets_of, shingle=shingle, keyed=keyed, similarity=similarity), "across"))


def leading(own: np.ndarray, common: bytes, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set in the order of (whether many texts have it, hash), as many as two similar sets must share one of."""
    most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    return own[np.lexsort((own, held(common, own.view(np.int64))))[:most]]


def leading_shingles(keyed: DataFrame, large: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """digest and each of the leading shingles (token) of the texts of large bins, two passes over these texts.

    Which shingles many of them have is told by a bitmap of bounded size; by chance it has others too, which changes the
    order for all texts alike and so loses no pair."""
    share = keyed.sparkSession.sparkContext.broadcast
    stands = share(bitmap(large.select(F.col("__row").alias("key")), large.count()))

    def each(made: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
            for ids, texts in batches:
                sets = [shingles(t, shingle) for t, ok in zip(texts, held(stands.value, np.array(ids, np.int64)).tolist(), strict=True) if ok]
                yield [list(map(digest, sets)), [made(s).view(np.int64) for s in sets]]

        rows = map_columns(keyed.select("__row", "text"), run, "digest long, tokens array<long>")
        return rows.join(large.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).select("digest", F.explode("tokens").alias("token"))

    many = written(each(lambda s: s).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select(F.col("token").alias("key")), "common")
    common = share(bitmap(many, many.count()))
    return each(lambda s: leading(s, common.value, similarity))


def across(near: DataFrame, large: DataFrame, sets_of: Callable[[DataFrame], DataFrame], *, keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links between texts of large bins that ``near`` leaves apart. large: digest, fp, n, bin, __row."""
    tokens = written(leading_shingles(keyed, large, shingle=shingle, similarity=similarity).join(large.select("digest", "fp", "n", "bin", "__row"), "digest"), "tokens")

    def labelled(links: DataFrame) -> DataFrame:
        """tokens with the label of each text's part, and the label that the most texts of its bin have."""
        labels = connected(links)
        own = written(large.select("digest", "bin").join(labels, F.col("digest") == F.col("node"), "left").select("digest", "bin", F.coalesce("root", "digest").alias("label")), "labels")
        most = own.groupBy("bin", "label").agg(F.count("*").alias("c")).groupBy("bin").agg(F.max(F.struct("c", "label")).alias("m")).select("bin", F.col("m.label").alias("most"))
        return written(tokens.join(own.select("digest", "label"), "digest").join(most, "bin"), "labelled")

    def proven(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of digests those that are similar."""
        ends = written(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct().join(large.select("digest", "__row"), "digest"), "ends")
        sets = written(sets_of(ends).join(ends, "digest", "left_semi").dropDuplicates(["digest"]), "sets")
        a, b = sets.select(F.col("digest").alias("a"), F.col("own").alias("x")), sets.select(F.col("digest").alias("b"), F.col("own").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(a, "a").join(b, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")

    few = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp1"))) <= MOST) & (F.least("n", "n1") >= similarity * F.greatest("n", "n1"))
    ordered = (F.least("digest", "digest1").alias("a"), F.greatest("digest", "digest1").alias("b"))
    # One text of each part that has a shingle meets the first of them.
    rows = labelled(near)
    parts = rows.groupBy("bin", "token", "label").agg(F.min(F.struct("digest", "fp", "n")).alias("x")).select("bin", "token", "label", "x.*")
    hubs = parts.groupBy("bin", "token").agg(F.min(F.struct("digest", "fp", "n", "label")).alias("h")).select("bin", "token", *(F.col(f"h.{c}").alias(f"{c}1") for c in ("digest", "fp", "n", "label")))
    stars = written(parts.join(hubs, ["bin", "token"]).where((F.col("label") != F.col("label1")) & few).select(*ordered).distinct(), "stars")
    joined = written(proven(stars), "joined")
    # What is still apart from the most of its bin meets all others that share a shingle.
    rows = labelled(near.union(joined))
    apart = rows.where("label <> most").select("bin", "token", *(F.col(c).alias(f"{c}1") for c in ("digest", "fp", "n", "label")))
    pairs = written(rows.join(apart, ["bin", "token"]).where((F.col("label") != F.col("label1")) & few).select(*ordered).distinct(), "pairs")
    return joined.union(proven(pairs))


def keep_first(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, bin_size: int = BIN) -> DataFrame:
    """One whole row of each group of near-duplicates."""
    names = docs.columns
    keyed = docs.withColumn("__row", row_key(docs))
    own = sketched(keyed, shingle)
    distinct = written(own.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"), *(F.any_value(c).alias(c) for c in ("fp", "n", "keys"))), "distinct")
    roots = connected(similar(keyed, distinct, shingle=shingle, similarity=similarity, bin_size=bin_size))
    firsts = distinct.select("digest", "first").join(roots, F.col("digest") == F.col("node"), "left").groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min("first").alias("first"))
    chosen = firsts.select(F.col("first.doc_id").alias("__id"), F.col("first.__row").alias("__first"))
    kept = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row"]).select(*names)
