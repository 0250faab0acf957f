"""Byte-level BPE through a SentencePiece model that is serialised from a vocabulary of ranks.

The vocabulary says which byte sequences are tokens, and in which order merges are made. Each byte is written as one
printable character, so a token becomes a piece; its score is its rank with the sign turned. With normalisation that
changes nothing, the library's merging of the best-scored pair, leftmost of equals, is the merging of the lowest rank.
The model is written field by field as the library's message, in memory; nothing is trained and no file is made.
Texts are cut into pre-tokens, each encoded by itself; those a worker meets again come from its cache, which keeps only
short ones, so its bytes are bounded. Decoding looks up the bytes of each id, by the same mapping turned round.

Defined results: a null text is encoded as an empty one: no ids, no bytes. There are no special tokens: strings that look
like some are ordinary text. Rows are handled each for itself, whatever their ids; a null doc_id is carried. Extra columns
are kept by round_trip() and ignored by digests(). A vocabulary that lacks a byte or repeats a rank raises.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._common import tokenizer_path
from gaugeline.llm.bpe_codec import LATIN, LATIN_WORDS, PATTERN, PLAIN_BYTES

VOCABULARY = "byte_bpe_50k.tiktoken"
AT_ONCE = 100_000  # pre-tokens
ROWS = 500  # texts of a batch that are held as ids at once
LONGEST, ROOM = 64, 200_000  # bytes of a pre-token that the cache keeps, and how many it keeps
# Field numbers of the model's message, the kinds of a piece and of a model in it.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, BPE, VOCABULARY_SIZE, UNKNOWN_ID = 3, 2, 4, 40
NAME, DUMMY_PREFIX, FEWER_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def byte_signs() -> str:
    """256 characters, none of them a space or control: the one at place b stands for byte b."""
    plain, other = set(PLAIN_BYTES), iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | float | bytes) -> bytes:
    """A field of a message in its wire format: an int as a varint, a float in four bytes, bytes with their length."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_proto(tokens: Iterable[bytes], signs: str) -> bytes:
    """The model whose pieces are the tokens, given in order of rank."""
    pieces = [t.decode("latin-1").translate(signs).encode() for t in tokens]
    unknown = field(PIECES, field(PIECE, b"<unk>") + field(SCORE, 0.0) + field(KIND, UNKNOWN))
    trainer = field(MODEL_TYPE, BPE) + field(VOCABULARY_SIZE, len(pieces) + 1) + field(UNKNOWN_ID, len(pieces))
    identity = field(NAME, b"identity") + field(DUMMY_PREFIX, 0) + field(FEWER_SPACES, 0) + field(ESCAPE_SPACES, 0)
    return b"".join(field(PIECES, field(PIECE, p) + field(SCORE, float(-rank))) for rank, p in enumerate(pieces)) + unknown + field(TRAINER, trainer) + field(NORMALIZER, identity)


class PieceCodec:
    """Encodes and decodes texts; ids are the vocabulary's ranks."""

    def __init__(self, path: str, room: int = ROOM):
        import sentencepiece

        ranks = read_ranks(path)
        tokens = sorted(ranks, key=ranks.__getitem__)
        if len(set(ranks.values())) < len(ranks) or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError(f"{path} repeats a rank or lacks a byte")
        self.signs = byte_signs()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens, self.signs))
        self.ids = np.array([ranks[t] for t in tokens], np.uint32)  # by the place of a piece
        back = {ord(c): b for b, c in enumerate(self.signs)}
        self.bytes_of = {int(i): self.library.id_to_piece(k).translate(back).encode("latin-1") for k, i in enumerate(self.ids)}
        self.words = regex.compile(PATTERN)
        self.room, self.known = room, {}

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each pre-token, as unsigned 32-bit integers in little-endian bytes."""
        words = list(words)
        coded = [w.encode("utf-8", "replace").decode("latin-1").translate(self.signs) for w in words]
        found = self.library.encode(coded, num_threads=1) if coded else []
        stops = np.cumsum([0, *(4 * len(x) for x in found)]).tolist()
        flat = self.ids[np.fromiter(chain.from_iterable(found), np.int64, stops[-1] // 4)].astype("<u4").tobytes()
        return {w: flat[a:z] for w, a, z in zip(words, stops, stops[1:], strict=False)}

    def parts(self, text: str) -> Iterator[list[str]]:
        """A text's pre-tokens; of a very long text so many at a time that it isn't held in pieces."""
        latin = LATIN.fullmatch(text)
        if len(text) <= AT_ONCE:
            yield LATIN_WORDS(text) if latin else self.words.findall(text)
            return
        found = (m[0] for m in self.words.finditer(text))
        while some := list(islice(found, AT_ONCE)):
            yield some

    def table(self, words: set[str]) -> dict[str, bytes]:
        """The ids of all the words, by word. Long ones are worked out each time and kept nowhere."""
        if len(self.known) > self.room:
            self.known = {}
        made = self.learn(words.difference(self.known))
        if all(len(w) <= LONGEST // 4 or len(w.encode("utf-8", "replace")) <= LONGEST for w in made):
            self.known |= made
            return self.known
        self.known |= {w: c for w, c in made.items() if len(w.encode("utf-8", "replace")) <= LONGEST}
        return self.known | made

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text. Some texts of together AT_ONCE pre-tokens, or a part of a longer one, are worked on at a time."""
        held: list[list[str]] = []  # pre-tokens of whole texts
        size = 0

        def out() -> Iterator[np.ndarray]:
            table = self.table(set().union(*held))
            for words in held:
                yield np.frombuffer(b"".join(map(table.__getitem__, words)), "<u4")
            held.clear()

        for text in texts:
            if len(text or "") > AT_ONCE:
                yield from out()
                whole = b"".join([b"".join(map(self.table(set(words)).__getitem__, words)) for words in self.parts(text)])
                yield np.frombuffer(whole, "<u4")
                size = 0
                continue
            held += self.parts(text or "")
            if (size := size + len(held[-1])) >= AT_ONCE:
                yield from out()
                size = 0
        yield from out()

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One for each Python worker, so that its cache serves all the worker's tasks."""
    return PieceCodec(path)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))


def round_trip(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of docs, then ids (array<int>) of each whole text and decoded (binary), the bytes that they give.

    A column of docs that has one of these names is replaced."""
    kept = [docs[c] for c in docs.columns if c not in ("ids", "decoded")]
    inner = docs.select(F.struct(*kept).alias("__row"), docs["text"].alias("__text"))
    schema = f"__row {inner.schema['__row'].dataType.simpleString()}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(vocabulary))
        for batch in _slices(batches):
            ids = list(own.encode_all(batch.column(1).to_pylist()))
            ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
            values = pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values), pa.array(map(own.decode, ids), pa.binary())], ["__row", "ids", "decoded"])

    return inner.mapInArrow(run, schema).select("__row.*", "ids", "decoded")


def digests(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids as little-endian unsigned 32-bit integers and of the decoded bytes.

    The same work as round_trip(), digested where it is done, so that ids and bytes needn't leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(vocabulary))
        for batch in _slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for ids in own.encode_all(batch.column(1).to_pylist()):
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out[2].append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
