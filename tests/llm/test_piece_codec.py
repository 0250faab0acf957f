"""The SentencePiece form of byte-level BPE, held against the library that the ranks are made for."""

import hashlib
import random
from collections import Counter

import pytest
from test_text_operators import random_texts

from gaugeline.llm import piece_codec
from gaugeline.llm._common import tokenizer_path


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = piece_codec.read_ranks(tokenizer_path(piece_codec.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(library):
    own = piece_codec.PieceCodec(tokenizer_path(piece_codec.VOCABULARY), room=300)
    texts = [*random_texts(4000, seed=4), "<unk>", "▁ <unk>", "x" * 300_000, "ab " * 60_000, "é" * 70]
    for t, ids in zip(texts, own.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()


def test_every_token_and_byte_is_itself():
    own = piece_codec.codec(tokenizer_path(piece_codec.VOCABULARY))
    ranks = piece_codec.read_ranks(tokenizer_path(piece_codec.VOCABULARY))
    coded = own.library.encode([t.decode("latin-1").translate(own.signs) for t in ranks], num_threads=1)
    assert [x == [r] for x, r in zip(coded, ranks.values(), strict=True)].count(False) == 0
    assert own.bytes_of == {r: t for t, r in ranks.items()}


def test_the_cache_is_bounded_by_bytes():
    own = piece_codec.PieceCodec(tokenizer_path(piece_codec.VOCABULARY), room=1000)
    r = random.Random(1)
    runs = [" ".join("".join(r.choice("abcdefgh") for _ in range(500)) for _ in range(20)) for _ in range(30)]
    list(own.encode_all([*runs, "short words stay"]))
    assert " words" in own.known and max(len(w.encode()) for w in own.known) <= piece_codec.LONGEST
    list(own.encode_all([f"w{k} " * 2 for k in range(5000)]))
    assert len(own.known) <= 1000 + piece_codec.AT_ONCE


def test_vocabularies_must_be_whole(tmp_path):
    import base64

    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + f" {b}\n".encode() for b in range(255)))
    with pytest.raises(ValueError, match="lacks a byte"):
        piece_codec.PieceCodec(str(path))


def test_digests_on_odd_rows(spark, odd, none, library):
    want = Counter()
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want[(r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    got = piece_codec.digests(odd)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and Counter(map(tuple, got.collect())) == want
    assert piece_codec.digests(none).count() == 0


def test_round_trip_keeps_rows_and_columns(odd, none, library):
    got = piece_codec.round_trip(odd)
    assert got.columns == [c for c in odd.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert piece_codec.round_trip(none).count() == 0
