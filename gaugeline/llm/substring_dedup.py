"""Substring dedup: words of long passages that an earlier document has too are removed.

A window is ``WINDOW`` words of a document. Each has an anchor, the run of ``GRAM`` words in it with the
least hash; equal windows have equal anchors. The windows of one anchor are a piece of a few words, and
1. one pass over the documents sums up, for each anchor, the first and last document and whether all pieces
   are the same. Anchors of one document are done with; where all pieces are the same, the first
   document is known. Bitmaps of bounded size tell these anchors apart in the next pass;
2. a second pass writes where the shared anchors are, and the words only of pieces that differ;
3. the distinct pieces of shared anchors are dealt out in reference shards. A task builds the suffix
   automaton of a shard, each state with the least document its strings occur in, and streams the pieces
   through it: matching statistics of ``WINDOW`` words or more end in the state that has the window's first
   document. Broadcasting the automata of all shards to all documents instead would cost their product;
4. each document's removed windows are joined to maximal spans and cut out.
An anchor in very many documents with pieces that differ is dealt out by single windows, so no shard is large.
More shared anchors than bitmaps can tell apart are taken in parts, each with a pass of its own over the documents.

Documents are ordered by doc_id, a null one last. Words are compared by 64-bit hashes, pieces by two hashes of 64 bits
of those, of the anchor and the whole piece, or of a single window under two bases. Two pieces are mistaken for
each other only if both agree by chance, or two words of equal hashes stand between the same other words.
Defined results: a null text has no words. Rows of one id don't remove words from each other.
Texts of fewer than ``WINDOW`` words are left alone. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._common import map_columns, written

WINDOW, GRAM = 13, 6
HOT = 4096  # pieces of an anchor, from which they are dealt out by windows
MOST_BITS = 28  # a bitmap has 2^28 bits at most
FULL = 4  # bits for each shared anchor at least; for more anchors there are several passes
SHARD_WORDS = 30_000
LAST = (1 << 63) - 1  # the order of a document without an id

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of hashes (the finish of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of one text: anchor keys, first windows, numbers of windows and content hashes."""

    def __init__(self, words: list[bytes], window: int = WINDOW, gram: int = GRAM):
        n = len(words)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)[:-1]
        self.others: np.ndarray | None = None
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(self.hashes * self.power, dtype=np.uint64)]
        grams = self.span(np.arange(n - gram + 1), gram)
        span = window - gram + 1
        anchor = np.arange(n - window + 1) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1)
        self.first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        self.windows = np.diff(np.r_[self.first, len(anchor)])
        self.key = grams[anchor[self.first]].view(np.int64)
        self.content = self.span(self.first, self.windows + window - 1).view(np.int64)
        self.window = window

    def span(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of runs of words."""
        return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))

    def other(self, start: np.ndarray, length: int) -> np.ndarray:
        """Hashes of runs of words that don't depend on those of span(); their sums are made once a text, if at all."""
        if self.others is None:
            self.others = np.r_[np.uint64(0), np.cumsum(_mixed(self.hashes ^ _BASE) * self.power, dtype=np.uint64)]
        return _mixed((self.others[start + length] - self.others[start]) * self.back[start] + np.uint64(length))

    def words(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k] + self.windows[k] + self.window - 1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def ordered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("place"), "text")


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, low and content of each anchor that two documents or more have; content is null where pieces differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, contents = [], [], []
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) >= window:
                    p = Pieces(words, window)
                    keys.append(p.key)
                    contents.append(p.content)
                    places.append(np.full(len(p.key), place))
                if sum(map(len, keys)) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, contents)], ["key", "place", "content"])
                    keys, places, contents = [], [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, contents)], ["key", "place", "content"])

    rows = ordered(docs).select("place", "text").mapInArrow(run, "key long, place long, content long")
    found = rows.groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min("content").alias("content"), F.max("content").alias("other"), F.count("*").alias("n"))
    return found.where("low < high").select("key", "low", F.when(F.col("content") == F.col("other"), F.col("content")).alias("content"), "n")


def bitmap(keys: DataFrame, n: int) -> bytes:
    """A set of the column key as 2^k bits, at least 16 a key but 2^MOST_BITS at most; other keys can be in it by chance."""
    bits = 1 << min(MOST_BITS, max(15, (16 * n).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    parts = keys.groupBy(F.shiftrightunsigned(at, 15).cast("int").alias("part")).agg(F.call_function("bitmap_construct_agg", at.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] * 4096 : row["part"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def held(bits: bytes, keys: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, np.uint8)
    at = keys.view(np.uint64) & np.uint64(8 * len(table) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Automaton:
    """A suffix automaton of several strings; low is the least document of each state's strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [LAST]

    def _state(self, length: int, steps: dict[int, int], link: int, low: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.low.append(low)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the strings of q that p's step on word makes, if q has longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], LAST)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int], low: int) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, q, word)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0, LAST), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.next[p][word], word)
                last = new
            if low < self.low[last]:
                self.low[last] = low

    def spread(self) -> None:
        """Carries each state's least document to the suffixes of its strings."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.low[v] < self.low[p]:
                self.low[p] = self.low[v]

    def firsts(self, words: list[int], window: int) -> list[int]:
        """The least document of each window of words, by matching statistics; LAST where no string has it."""
        out, state, matched = [], 0, 0
        for n, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if n >= window:
                out.append(self.low[state] if matched >= window else LAST)
        return out


def first_documents(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """route, content and firsts (for each window its first document) of the distinct pieces (route, content, low, words)."""

    def solve(shard: list[tuple[int, int, int, list[int]]]) -> list[list]:
        own = Automaton()
        for _, _, low, words in shard:
            own.add(words, low)
        own.spread()
        return [[s[0] for s in shard], [s[1] for s in shard], [own.firsts(s[3], window) for s in shard]]

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        shard: list[tuple[int, int, int, list[int]]] = []
        size = 0
        for batch in batches:
            for row in zip(*batch, strict=True):
                if size > SHARD_WORDS and row[0] != shard[-1][0]:  # pieces of one route stay together
                    yield solve(shard)
                    shard, size = [], 0
                shard.append(row)
                size += len(row[3])
        if shard:
            yield solve(shard)

    dealt = pieces.select("route", "content", "low", "words").repartition("route").sortWithinPartitions("route", "content")
    return map_columns(dealt, run, "route long, content long, firsts array<long>")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many parts a key belongs to; the low bits, by which a bitmap tells keys apart, don't decide it."""
    return (keys.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)


def occurrences(docs: DataFrame, shared: bytes, mixed: bytes, hot: bytes, window: int = WINDOW, part: int = 0, parts: int = 1) -> DataFrame:
    """doc_id, place, text_hash, route, content, first, windows and, where pieces differ, words of what shared anchors of a part have."""
    spark = docs.sparkSession
    sets = spark.sparkContext.broadcast((shared, mixed, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, mixed, hot = sets.value
        schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("text_hash", pa.int64()), ("route", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("words", pa.list_(pa.int64()))])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, place, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                p, h = Pieces(words, window), text_hash(text)
                in_shared = held(shared, p.key)
                if parts > 1:
                    in_shared &= part_of(p.key, parts) == part
                in_mixed, in_hot = in_shared & held(mixed, p.key), in_shared & held(hot, p.key)
                for k in np.flatnonzero(in_shared).tolist():
                    first, n = int(p.first[k]), int(p.windows[k])
                    if in_hot[k]:
                        at = np.arange(first, first + n)
                        each = zip(p.span(at, window).view(np.int64).tolist(), p.other(at, window).view(np.int64).tolist(), strict=True)
                        out += [(doc_id, place, h, e, o, first + i, 1, p.hashes[first + i : first + i + window].view(np.int64)) for i, (e, o) in enumerate(each)]
                    else:
                        out.append((doc_id, place, h, int(p.key[k]), int(p.content[k]), first, n, p.words(k).view(np.int64) if in_mixed[k] else None))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*out, strict=True)), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*out, strict=True)), schema, strict=True)], schema=schema)

    return ordered(docs).mapInArrow(run, "doc_id long, place long, text_hash long, route long, content long, first int, windows int, words array<long>")


def text_hash(text: str | None) -> int:
    h = xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def removed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """place, text_hash and starts (of removed windows: first and number) of each text that loses words."""
    known = written(anchors(docs, window), "anchors")
    counts = known.agg(F.count("*").alias("all"), F.count(F.when(F.col("content").isNull(), 1)).alias("mixed"), F.count(F.when(F.col("content").isNull() & (F.col("n") > HOT), 1)).alias("hot")).first()
    parts = max(1, -(-counts["all"] * FULL >> MOST_BITS))
    found = None
    for part in range(parts):
        # As part_of(): the quotient of an unsigned number of 32 bits.
        own = known if parts == 1 else known.where(F.shiftrightunsigned("key", 32) % parts == part)
        differ = own.where("content IS NULL")
        sets = [bitmap(keys, -(-n // parts)) for keys, n in ((own, counts["all"]), (differ, counts["mixed"]), (differ.where(F.col("n") > HOT), counts["hot"]))]
        one = written(occurrences(docs, *sets, window, part, parts), "occurrences")
        found = one if found is None else found.unionByName(one)
    # Sums over what map tasks have seen come first, so a piece of very many documents is one row a task.
    distinct = found.where("words IS NOT NULL").groupBy("route", "content").agg(F.min("place").alias("low"), F.any_value("words").alias("words"))
    solved = first_documents(distinct, window).select("route", "content", "firsts", F.lit(None).cast("long").alias("low"))
    same = known.where("content IS NOT NULL").select(F.col("key").alias("route"), "content", F.lit(None).cast("array<long>").alias("firsts"), "low")
    firsts = same.unionByName(solved)
    lost = found.select("place", "text_hash", "route", "content", "first", "windows").join(firsts, ["route", "content"]).where((F.col("low") < F.col("place")) | F.exists("firsts", lambda d: d < F.col("place")))
    every = F.when(F.col("firsts").isNull(), F.array(F.struct(F.col("first").alias("at"), F.col("windows").alias("n")))).otherwise(
        F.filter(F.transform("firsts", lambda d, i: F.when(d < F.col("place"), F.struct((F.col("first") + i).cast("int").alias("at"), F.lit(1).alias("n")))), lambda s: s.isNotNull())
    )
    return lost.withColumn("starts", every).groupBy("place", "text_hash").agg(F.flatten(F.collect_set("starts")).alias("starts"))


def dedup(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that are left, joined by spaces, of each document."""
    spans = written(removed_windows(docs, window), "spans")
    losing = docs.sparkSession.sparkContext.broadcast(bitmap(spans.select(F.col("text_hash").alias("key")), spans.count()))

    def probe(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        # Texts that lose nothing get their digest here and don't travel; a few others do by chance.
        for ids, places, texts in batches:
            hashes = list(map(text_hash, texts))
            travels = held(losing.value, np.array(hashes, np.int64)).tolist()
            words = list(map(words_of, texts))
            digests = [None if t else hashlib.sha256(b" ".join(w)).hexdigest() for t, w in zip(travels, words, strict=True)]
            yield [ids, places, [h if t else None for h, t in zip(hashes, travels, strict=True)], list(map(len, words)), digests, [x if t else None for x, t in zip(texts, travels, strict=True)]]

    probed = map_columns(ordered(docs), probe, "doc_id long, place long, text_hash long, n_words long, kept_sha256 string, text string")
    joined = probed.join(spans, ["place", "text_hash"], "left").select("doc_id", "n_words", "kept_sha256", "text", F.transform("starts", lambda s: s["at"]).alias("at"), F.transform("starts", lambda s: s["n"]).alias("n"))

    def cut(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, counts, digests, texts, ats, ns in batches:
            removed, digests = [0] * len(ids), list(digests)
            for k, (text, at, n) in enumerate(zip(texts, ats, ns, strict=True)):
                if digests[k] is None:
                    words = words_of(text)
                    edges = np.zeros(len(words) + 1, np.int64)
                    if at:
                        np.add.at(edges, np.array(at), 1)
                        np.add.at(edges, np.array(at) + np.array(n) + window - 1, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    removed[k] = int(gone.sum())
                    digests[k] = hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest()
            yield [ids, counts, removed, digests]

    return map_columns(joined, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
