"""The pipeline's near-duplicate stage against brute-force Jaccard pairs."""

import random

import pytest

import corpus_pipeline as p
from gaugeline.llm import simhash_near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("th er on an re en ti es or ou ha in ed".split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def brute_first(rows):
    def grams(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
                pairs += a != b
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low.setdefault(find(i), []).append(doc_id)
    return pairs, sorted(min((x for x in ids if x is not None), default=-1) for ids in low.values())


def near_rows():
    """Copies with one to many changed words on both sides of 0.8, chains of them, and one passage in all texts."""
    r = random.Random(8)
    passage, rows = words(r, 30), []
    for _ in range(12):
        now = words(r, r.randint(12, 150)).split(" ")
        rows.append(" ".join(now))
        for _ in range(6):
            now = list(now)
            for _ in range(r.randint(1, max(1, len(now) // 30))):
                now[r.randrange(len(now))] = words(r, 1)
            rows.append(" ".join(now))
    rows += [f"{passage} {words(r, 40)}" for _ in range(30)] + [f"{passage} tail{k}" for k in range(30)]
    r.shuffle(rows)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("bin_size", "large"), [(4096, 4096), (8, 5), (3, 4096)])
def test_keeps_the_first_of_all_that_is_similar(spark, monkeypatch, bin_size, large):
    """Whether bins and groups of bands are dealt out in parts or not."""
    monkeypatch.setattr(simhash_near, "LARGE", large)
    rows = near_rows()
    pairs, want = brute_first([x[:2] for x in rows])
    assert pairs > 30 and len(want) < len(rows) - 30
    got = simhash_near.keep_first(spark.createDataFrame(rows, DOCS).repartition(3), bin_size=bin_size)
    assert sorted(x.doc_id for x in got.collect()) == want


def test_stage(spark, odd, none):
    rows = near_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted(x.doc_id for x in p.near_duplicates(spark, docs, "").collect()) == brute_first([x[:2] for x in rows])[1]
    kept = p.near_duplicates(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in kept.collect()) == brute_first([(x.doc_id, x.text) for x in odd.collect()])[1]
    assert p.near_duplicates(spark, none, "").count() == 0


def test_texts_of_one_template_make_few_pairs(spark, monkeypatch):
    """Texts that share a template and are no duplicates: bins are forced to split, and pairs don't grow with their square."""
    r = random.Random(4)
    template = [words(r, 1) + str(k) for k in range(70)]
    texts = [" ".join([*template, *(f"own{k}x{i}" for i in range(22))]) for k in range(800)]
    texts += [" ".join([*t.split(" ")[:-1], "end"]) for t in texts[:40]] + [t + " more" for t in texts[:40]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    made = {}

    def noted(df, name="table"):
        out = written(df, name)
        if name in ("stars", "pairs", "tokens"):
            made[name] = out.count()
        return out

    written = simhash_near.written
    monkeypatch.setattr(simhash_near, "written", noted)
    got = simhash_near.keep_first(spark.createDataFrame(rows, DOCS).repartition(3), bin_size=64)
    assert sorted(x.doc_id for x in got.collect()) == list(range(800))
    assert made["tokens"] < 25 * len(texts) and made["stars"] + made["pairs"] < 2 * len(texts)


def test_leading_shingles_of_similar_sets_meet():
    import numpy as np

    r = np.random.default_rng(1)
    common = b"\xff" * 2048 + b"\x00" * 2048
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 60)).astype(np.uint64))
        b = a.copy()
        for _ in range(r.integers(0, 1 + len(a) // 4)):
            b[r.integers(len(b))] = r.integers(0, 1 << 63)
        b = np.unique(b)
        if simhash_near.alike(a, b):
            assert np.intersect1d(simhash_near.leading(a, common), simhash_near.leading(b, common)).size
