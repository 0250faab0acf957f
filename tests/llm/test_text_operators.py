"""Operators that look at each text by itself, held against the libraries or plain code."""

import random
import re
from collections import Counter

import pytest

from gaugeline.llm import bpe_codec, licenses, pii, quality_rules, token_counts
from gaugeline.llm._common import tokenizer_path

PIECES = [" ", "  ", "\n", "a", "b", "the", "▁", "\0", "é", "日本", "<s>", "</s>", "\t", ".", "1", "\U0001f642", "foo's bar", "'ll", "\r\n", "\x1c", "\x85", " ", "²", "Ⅷ", "्", "　", "<|endoftext|>", "<|end", "aaaaaaa"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_pre_token_lengths_add_up():
    own = token_counts.Lengths(tokenizer_path(token_counts.MODEL), {}, 100)
    for t in random_texts(4000):
        assert own.total(t) == len(own.library.encode(t)), t


def test_token_counts(spark, odd, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.MODEL))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, table_size=50).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in odd.collect())
    assert got == want
    assert token_counts.count_tokens(none).count() == 0


def test_codec_is_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(bpe_codec.VOCABULARY))
    own = bpe_codec.Codec(tokenizer_path(bpe_codec.VOCABULARY), room=500)
    texts = random_texts(4000, seed=2)
    for t, ids in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("width", [1, 2, 4, 16, 32])
def test_one_tree_and_many_trees_merge_alike(width):
    own = bpe_codec.codec(tokenizer_path(bpe_codec.VOCABULARY))
    r = random.Random(width)
    words = [bytes(r.choice(b"abcdefgheee ttt") for _ in range(r.randint(1, width + 1))) for _ in range(500)]
    assert own.merge_many(words, width) == [own.merge(list(map(own.first.__getitem__, w))) for w in words]


def test_round_trip_keeps_rows_and_columns(odd, none):
    got = bpe_codec.round_trip(odd)
    assert got.columns == [c for c in odd.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    for r in got.collect():
        assert r.decoded == (r.text or "") and isinstance(r.ids, list)
    assert bpe_codec.digests(none).count() == 0


def brute_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_and_base_rule(odd, none):
    got = quality_rules.judge(odd, []).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(brute_counts(r.text))
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own in texts[r.doc_id]
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)
    assert len(got) == odd.count()
    assert quality_rules.judge(none, []).count() == 0


def test_rules_are_learned_and_hold_on_other_rows(spark):
    r = random.Random(3)
    word = lambda: r.choice(["tree", "house", "river", "stone", "cloud"]) + str(r.randrange(400))

    def text(bad):
        return " ".join(word() + ("$$$" if bad and r.random() < 0.6 else "") for _ in range(80))

    rows = [(i, text(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(300)] + [(None, 0), (5, None), (6, 0)], "doc_id long, quality int")
    rules = quality_rules.fit_rules(docs, labels)
    assert rules and rules[0].tests[0][0] == "symbols_per_word"
    held = [x for x in quality_rules.judge(docs, rules).collect() if x.doc_id >= 300]
    assert all(x.kept == (x.doc_id % 4 != 0) for x in held)
    assert sorted(x.doc_id for x in quality_rules.keep_good(docs, rules).collect()) == [i for i in range(600) if i % 4]
    assert quality_rules.fit_rules(docs, labels.limit(0)) == []


def brute_pii(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed([int(c) for c in d]))) % 10 == 0

    t, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_base_spans_are_the_plain_patterns(spark, odd, none, model):
    import hashlib

    r = random.Random(3)
    parts = ["a", "b.", "@", ".", "-", "+1", "1", "22", "256", "7", " ", "(", "é", "\U0001f642", "4111111111111111", "x@y.z", "1.2.3.4", "+1 (415) 555-1234", "\n", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(800)] + [None, "", "1" * 3000, "a@b" + ".c" * 3000, "1.2.3.4 " * 700, "+1" + "(" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find(frame, *model).collect():
        want = brute_pii(texts[row.doc_id])
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == w[0] for w in want) for k in ("email", "ip", "card", "phone"))
        assert {f"{k}:{a}:{z}" for k, a, z in want} <= set(row.spans.split(","))
    assert pii.find(odd, *model).count() == odd.count()
    assert pii.find(none, *model).count() == 0


def test_long_runs_cost_linear_time(spark, model):
    texts = ["1" * 200_000, "a" * 200_000, "1 " * 100_000, "x@" * 50_000, "(at)" + " a [dot]" * 20_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find(frame, *model).count() == len(texts)


def test_trees_find_what_they_never_saw(spark, model):
    truth = pii.made_up(600, seed=99)
    frame = spark.createDataFrame([(k, t) for k, t, *_ in truth], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.find(frame, *model).collect()}
    real = [(k, f"{pii.KINDS[kind]}:{a}:{z}") for k, _, a, z, kind in truth if kind >= 0]
    false = [k for k, *_, kind in truth if kind < 0 and got[k]]
    assert sum(s in got[k] for k, s in real) >= 0.97 * len(real)
    assert len(false) <= 0.02 * len(truth)


def test_trees_in_sql_are_the_trees(spark, model):
    """On made-up features, those of the thresholds themselves among them."""
    import numpy as np
    from pyspark.sql import functions as F

    trees, _ = model
    r = np.random.default_rng(3)
    cuts = [t.threshold for t in trees.trees if t.left is not None]
    x = np.where(r.random((300, 14)) < 0.3, r.choice(cuts, (300, 14)), r.uniform(0, 45, (300, 14)))
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, x array<double>")
    got = [v.m for v in rows.select("i", F.expr(trees.sql("x")).alias("m")).orderBy("i").collect()]
    assert got == pytest.approx(trees.margin(x).tolist(), abs=1e-9)


def test_redaction(spark, model):
    text = "mail a@b.cd, card 4111 1111 1111 1111 \U0001f642 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" end"
    frame = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, kind string")
    got = {r.doc_id: r.text for r in pii.redacted(frame, *model).collect()}
    assert got == {1: 'mail [EMAIL], card [CARD] \U0001f642 token = "[SECRET]" end', 2: None, 3: "clean"}


def test_licenses(odd, none):
    scanner = licenses.train()
    r = random.Random(77)
    right = total = 0
    for name, templates in licenses.TEMPLATES.items():
        for _ in range(40):
            total += 1
            right += scanner.license(licenses._varied(r, r.choice(templates))) == name
    assert right >= 0.93 * total
    prose = [licenses._varied(r, r.choice(licenses.ORDINARY)) for _ in range(200)]
    assert sum(scanner.license(p) == licenses.PROSE for p in prose) >= 196
    assert scanner.scan("Plain words.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.") == (3, 2, 0, ["apache", "mit"])
    assert scanner.scan(None) == (0, 0, 0, [])
    assert licenses.scan_licenses(odd, scanner).count() == odd.count()
    assert licenses.scan_licenses(none, scanner).count() == 0


def test_planted_secrets_and_cards_are_found(spark, model):
    """Recall and precision of added spans on the documents, whose planted rows no training sentence comes from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: {s for s in r.spans.split(",") if s.startswith("secret")} for r in pii.find(docs, *model).collect()}
    planted = {(i, f"secret:{m.start(1)}:{m.end(1)}") for i, t in text.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    added = {(i, s) for i, spans in got.items() for s in spans}
    assert len(planted) > 5
    assert len(planted & added) >= 0.9 * len(planted)
    assert len(planted & added) >= 0.9 * len(added)


def test_one_cache_serves_a_workers_tasks():
    """The model is loaded once for a count, and what a task encoded the next one finds."""
    path = tokenizer_path(token_counts.MODEL)
    first = token_counts.worker_lengths("a", path, {"the": 1}, 50)
    first.total("some words that are new")
    again = token_counts.worker_lengths("a", path, {"the": 1}, 50)
    assert again is first and "words" in again and again.library is first.library
    assert token_counts.worker_lengths("b", path, {}, 50) is not first and len(token_counts._HELD) == 1


def test_codec_keeps_short_pre_tokens_only():
    own = bpe_codec.Codec(tokenizer_path(bpe_codec.VOCABULARY))
    r = random.Random(2)
    runs = [" ".join("".join(r.choice("abcdefgh") for _ in range(700)) for _ in range(30)) for _ in range(20)]
    before = own.encode_all(runs)
    assert max(len(w.encode()) for w in own) <= bpe_codec.LONGEST and len(own) < 50
    assert own.encode_all(runs) == before and own.encode_all(["a short one"]) and " short" in own


def test_codec_digests_are_the_librarys(spark, odd, none):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(bpe_codec.VOCABULARY))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe_codec.digests(odd).collect())) == want
