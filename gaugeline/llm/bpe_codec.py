"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut at the special strings, then into pre-tokens. The leaves of a pre-token's tree hold the
merge ranks of its adjacent symbols; the root is the lowest rank, the leftmost of equals. Each merge
updates at most three leaves, in logarithmic time, until the root holds no rank. So a pre-token of any
length costs n log n. A cache in each Python worker keeps what short pre-tokens
gave, so its bytes are bounded.

Defined results: a null text is encoded as an empty one: no ids, an empty decoded text. Special strings in
a text get their own ids, as the library does by default. Decoding puts U+FFFD for bytes that aren't
UTF-8. Rows are handled each for itself; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._common import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
# Fixed values of byte-level BPE: how it cuts texts, and the characters that stand for bytes as they are.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The same cuts for texts below U+0250, where the classes are short enough to be written out.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN = re.compile("[\0-\u024f]*")
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
AT_ONCE = 100_000  # pre-tokens
ROWS = 500  # texts of a batch that are held as ids at once
LONGEST = 64  # bytes of a pre-token that the cache keeps
NONE = 1 << 62


class Codec(dict):
    """Encodes and decodes; as a dict, the cache of ids by pre-token."""

    def __init__(self, path: str, room: int = 200_000):
        super().__init__()
        self.room = room
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        sign = dict(zip(PLAIN_BYTES, map(chr, PLAIN_BYTES), strict=True))
        sign.update({b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(PLAIN_BYTES)))})
        byte = {c: b for b, c in sign.items()}
        self.first = [vocabulary[sign[b]] for b in range(256)]
        self.bytes_of = {i: bytes(map(byte.__getitem__, t)) for t, i in vocabulary.items() if all(map(byte.__contains__, t))}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {vocabulary[a] << 32 | vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        self.first_of, self.made_of = np.array(self.first), np.array(self.made)
        self.pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(self.pairs)
        self.pairs, self.pair_rank = self.pairs[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN).findall

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first, leftmost of equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, made = self.rank.get, self.made
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        shift = width.bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            r = rank(symbols[i] << 32 | symbols[i + 1])
            if r is not None:
                tree[width + i] = r << shift | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (top := tree[1]) != NONE:
            i = top & ((1 << shift) - 1)
            symbols[i] = made[top >> shift]
            j = after[i]
            after[i] = k = after[j]
            before[k] = i
            symbols[j] = -1
            changed = [(i, NONE if k >= n or (r := rank(symbols[i] << 32 | symbols[k])) is None else r << shift | i)]
            if j < n - 1:
                changed.append((j, NONE))
            if (h := before[i]) >= 0:
                changed.append((h, NONE if (r := rank(symbols[h] << 32 | symbols[i])) is None else r << shift | h))
            for leaf, value in changed:
                k = width + leaf
                if tree[k] != value:
                    tree[k] = value
                    while k > 1:
                        other = tree[k ^ 1]
                        k >>= 1
                        if other < value:
                            value = other
                        if tree[k] == value:
                            break
                        tree[k] = value
        return [s for s in symbols if s >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none or a symbol is -1."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_rank[at], -1)

    def merge_many(self, words: list[bytes], width: int) -> list[list[int]]:
        """As merge(), for many words of at most width + 1 bytes: one tree a row, a merge in each row a step."""
        shift, rows = width.bit_length(), len(words)
        lengths = np.fromiter(map(len, words), np.int64, rows)
        symbols = np.full((rows, width + 2), -1, np.int64)
        symbols[np.arange(width + 2) < lengths[:, None]] = self.first_of[np.frombuffer(b"".join(words), np.uint8)]
        leaves = lambda r, i: np.where(r < 0, NONE, r << shift | i)
        tree = np.full((rows, 2 * width), NONE, np.int64)
        tree[:, width:] = leaves(self.ranks(symbols[:, :width], symbols[:, 1 : width + 1]), np.arange(width))
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 3), (rows, 1))
        before = np.tile(np.arange(-1, width + 2), (rows, 1))
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            top = tree[live, 1]
            i = top & ((1 << shift) - 1)
            j = after[live, i]
            k = np.minimum(after[live, j], width + 1)  # the last column holds no symbol
            h = before[live, i]
            symbols[live, i], symbols[live, j] = self.made_of[top >> shift], -1
            after[live, i], before[live, k] = k, i
            has_left, ends = h >= 0, j < width
            at = np.concatenate([live, live[has_left], live[ends]])
            node = width + np.concatenate([i, h[has_left], j[ends]])
            to_right = leaves(self.ranks(symbols[live, i], symbols[live, k]), i)
            to_left = leaves(self.ranks(symbols[live[has_left], h[has_left]], symbols[live[has_left], i[has_left]]), h[has_left])
            tree[at, node] = np.concatenate([to_right, to_left, np.full(ends.sum(), NONE)])
            while (node := node >> 1)[0]:
                tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
            live = live[tree[live, 1] != NONE]
        left = symbols >= 0
        flat, stops = symbols[left].tolist(), np.cumsum(left.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of words that the cache lacks into it."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            coded = word.encode("utf-8", "replace")
            by_width.setdefault(1 << max(0, len(coded) - 2).bit_length(), []).append((word, coded))
        for width, some in by_width.items():
            if width <= 64 and len(some) > 8:
                self.update(zip([w for w, _ in some], self.merge_many([c for _, c in some], width), strict=True))
            else:
                self.update((w, self.merge(list(map(self.first.__getitem__, c)))) for w, c in some)

    def pieces(self, text: str) -> list[str]:
        """A text's pre-tokens; special strings stay whole, and have their ids in the cache."""
        cut = (LATIN_WORDS if LATIN.fullmatch(text) else self.words)
        if self.cut is None or not (marks := list(self.cut.finditer(text))):
            return cut(text)
        out, at = [], 0
        for m in marks:
            out += [*cut(text[at : m.start()]), m[0]]
            at = m.end()
        return out + cut(text[at:])

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text. Works on a few texts at a time, so that little besides the ids is held."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < AT_ONCE:
                some.append(self.pieces(texts[at] or ""))
                size += len(some[-1])
                at += 1
            if len(self) > self.room:
                self.clear()
            self.update((t, [i]) for t, i in self.special.items())
            new = set().union(*some).difference(self)
            self.learn(new)
            out += [list(chain.from_iterable(map(self.__getitem__, s))) for s in some]
            for word in new:
                if 4 * len(word) > LONGEST and len(word.encode("utf-8", "replace")) > LONGEST and word not in self.special:
                    del self[word]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker, so that its cache serves all the worker's tasks."""
    return Codec(path)


def round_trip(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of docs, then ids (array<int>) of each whole text and decoded, the text that they give.

    A column of docs that has one of these names is replaced."""
    kept = [docs[c] for c in docs.columns if c not in ("ids", "decoded")]
    inner = docs.select(F.struct(*kept).alias("__row") if kept else F.lit(None).alias("__row"), docs["text"].alias("__text"))
    schema = f"__row {inner.schema['__row'].dataType.simpleString()}, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(vocabulary))
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids = own.encode_all(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(map(own.decode, ids), pa.string())], ["__row", "ids", "decoded"])

    return inner.mapInArrow(run, schema).select("__row.*", "ids", "decoded")


def digests(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids, joined by commas, and of the decoded text."""
    coded = round_trip(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text"), vocabulary=vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
