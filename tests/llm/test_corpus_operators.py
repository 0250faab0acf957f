"""Operators that hold documents against each other, each against a brute-force version."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeline.llm import bsi_topk, mixing, simhash, substring_dedup, warc
from gaugeline.llm._common import row_key, shared_dir


def brute_top(rows, k=5, every=50):
    import math

    use = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = set(), {}
    for i, q in use:
        if i % every == 0:
            asked[i] = min(asked.get(i, (len(q), q)), (len(q), q))
    for i, (_, q) in asked.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in use if j != i and len(v) == len(q))[:k]
        out |= {(i, n, j, -s) for n, (s, j) in enumerate(found, 1)}
    return out


def test_top_k(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 0.3, 8))]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 520)] + [(600, None), (650, [None] * 8), (651, [float("nan")] * 8), (652, [float("inf")] * 8), (None, rows[0][1]), (700, [1.0, 2.0]), (701, [0.5, -1.0]), (50, rows[50][1]), (50, rows[51][1]), (750, [0.0] * 8), (800, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = bsi_topk.top_k(frame.withColumn("score", F.lit("x")).withColumn("q", F.lit(1)), block_rows=100)
    seen = Counter((x.query_id, x.rank, x.score) for x in got.collect())
    want = Counter((q, n, s) for q, n, _, s in brute_top(rows))
    assert seen == want
    single = [x for x in rows if x[0] != 50]
    got = bsi_topk.top_k(spark.createDataFrame(single, "vec_id long, embedding array<float>"), block_rows=64)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(single)
    assert bsi_topk.top_k(frame.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Sums within 64 bits come out right whatever the components; only a returned score beyond them raises."""
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4)]) for i in range(120)]
    rows += [(i, [float(x) for x in r.normal(0, 2.0**20, 4)]) for i in range(200, 260)] + [(300, [1e6, -1e6, 0.5, 0.0]), (301, [2.0**24, 0.0, 0.0, 0.0]), (350, [0.0, 0.0, 0.0, 2.0**-3])]
    schema = "vec_id long, embedding array<double>"
    got = bsi_topk.top_k(spark.createDataFrame(rows, schema), block_rows=40)
    assert {tuple(x) for x in got.collect()} == brute_top(rows)
    apart = [(0, [1e300, 0.0]), (1, [0.0, 3.0]), (2, [0.0, -3.0])]
    got = bsi_topk.top_k(spark.createDataFrame(apart, schema))
    assert [(x["rank"], x.vec_id, x.score) for x in got.orderBy("rank").collect()] == [(1, 1, 0), (2, 2, 0)]
    with pytest.raises(Exception, match="too large|too big|int64|OverflowError"):
        bsi_topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1e300])], schema)).collect()


def test_rows_are_shuffled_once_whatever_the_queries(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(1000)], "vec_id long, embedding array<float>")
    text = bsi_topk.top_k(rows, block_rows=100, every=1)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate explode") == 1  # of the queries; rows aren't replicated


def test_bit_slices_add_and_select():
    r = np.random.default_rng(1)
    values = r.integers(-40, 40, (300, 5))
    block = bsi_topk.SlicedBlock(np.arange(300), values, left_out=1)
    for _ in range(20):
        q = r.integers(-30, 30, 5)
        ids, scores = block.top(q, 7, 5)
        full = sorted((-int(v @ q), i) for i, v in enumerate(values) if i != 7)[:5]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == full


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
        assert (r.first_position is None) == (r.taken == 0)
        assert r.first_position is None or 0 <= r.first_position <= 1
    sizes = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    rest = 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= full
    for s, rows in by.items():
        assert rows[0].source_size == sizes[s] and rows[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in rows) - target[s]) <= 1
    again = sorted(map(tuple, mixing.mix(odd.repartition(2)).select("doc_id", "size", "taken").collect()), key=str)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got), key=str) == again
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert abs(sum(len((r.text or "").split()) for r in out.collect()) - sum(target.values())) <= 0.3 * sum(target.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_schedules_are_inverted(spark):
    from pyspark.sql import functions as F

    for schedule in mixing.SCHEDULES:
        shares = spark.createDataFrame([(x / 20,) for x in range(21)], "x double")
        times = [r.t for r in shares.select("x", mixing.demand_inverse(F.col("x"), schedule).alias("t")).orderBy("x").collect()]
        at = np.linspace(0, 1, 200_001)
        weights = np.interp(at, [p[0] for p in schedule], [p[1] for p in schedule])
        done = np.concatenate([[0], np.cumsum((weights[1:] + weights[:-1]) / 2)]) / ((weights[1:] + weights[:-1]) / 2).sum()
        assert times == pytest.approx([float(np.interp(x / 20, done, at)) for x in range(21)], abs=1e-4)


def brute_components(rows):
    import xxhash

    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    cache = {}
    fps = [cache.setdefault(t, fp(t)) if t not in cache else cache[t] for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)].append(doc_id)
    return Counter((doc_id, fps[i], min((x for x in low[find(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows))


def test_simhash(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.components(odd).collect())
    want = brute_components(rows)
    assert got == want
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {(c if c is not None else f) for _, f, c in want}
    assert len(ids) == len(groups) and {i for i in ids if i is not None} == {c for _, _, c in want if c is not None}
    assert simhash.components(none).count() == 0


def test_simhash_of_one_text_in_most_rows(spark):
    rows = [(i, "the same few words again" if i % 10 else f"a text of its own number {i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for share in (0.001, 0.5, 1.0):
        got = simhash.components(frame, hot_share=share)
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()) == brute_components(rows)


def test_a_rows_key_tells_where_nulls_are(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, "x", None, "a"), (1, "x", "a", None)], "doc_id long, text string, b string, c string")
    mapped = frame.withColumn("m", F.create_map(F.lit("k"), F.col("b")))
    assert mapped.select(row_key(mapped).alias("k")).distinct().count() == 2
    assert simhash.keep_first(mapped).columns == mapped.columns and simhash.keep_first(mapped).count() == 1


@pytest.mark.parametrize("group_rows", [4, 40, 4096])
def test_links_join_all_that_is_near(spark, group_rows):
    """Whether groups are split or not; chains and near copies of one fingerprint."""
    r = np.random.default_rng(group_rows)
    base = r.integers(0, 2**63, 4).astype(np.uint64)
    flips = lambda n: np.bitwise_or(np.uint64(1) << r.integers(0, 64, n).astype(np.uint64), np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
    chain = [base[0]]
    for k in range(20):
        chain.append(chain[-1] ^ np.uint64(1 << (3 * k)))
    fps = np.unique(np.concatenate([*(b ^ flips(40) for b in base), np.array(chain), r.integers(0, 2**63, 60).astype(np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {x.node: x.root for x in simhash.connected(simhash.links(frame, group_rows=group_rows)).collect()}
    labels = simhash.united(np.arange(len(fps)), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2))
    signed = fps.view(np.int64).tolist()
    groups = defaultdict(set)
    for i, label in enumerate(labels):
        groups[label].add(signed[i])
    for members in groups.values():
        assert {root.get(m, m) for m in members} == {min(members)}


def test_gray_index_misses_nothing():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 3).astype(np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) for b in base]))
    q, found = simhash.GrayIndex(fps).near(fps, 2)
    assert set(zip(q.tolist(), found.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2))))


def brute_dedup(rows, window=13):
    last = 1 << 63
    first, split = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, last), last if i is None else i)
    out = Counter()
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (last if i is None else i):
                gone.update(range(s, s + window))
        out[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("hot", "bits"), [(4096, 28), (2, 28), (2, 15)])
def test_substring_dedup(odd, none, monkeypatch, hot, bits):
    """Whether anchors are dealt out by windows, and documents read in several passes, or not."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "MOST_BITS", bits)
    monkeypatch.setattr(substring_dedup, "FULL", 4 if bits == 28 else 12)
    got = Counter(tuple(r) for r in substring_dedup.dedup(odd).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_dedup([(r.doc_id, r.text) for r in odd.collect()])
    assert substring_dedup.dedup(none).count() == 0


def test_automaton_knows_the_first_document():
    import random

    r = random.Random(2)
    pieces = [([r.randrange(3) for _ in range(r.randint(4, 25))], r.randrange(50)) for _ in range(60)]
    own = substring_dedup.Automaton()
    for words, low in pieces:
        own.add(words, low)
    own.spread()
    for words, _ in [*pieces, ([r.randrange(4) for _ in range(40)], 0)]:
        want = [min((low for other, low in pieces if any(other[k : k + 4] == words[s : s + 4] for k in range(len(other) - 3))), default=substring_dedup.LAST) for s in range(len(words) - 3)]
        assert own.firsts(words, 4) == want


def page_rows():
    trap = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nafter"
    texts = ["<p>one</p>", "", None, "<p>one</p>", trap, "WARC/1.1\r\n" * 40, "é" * 3000, trap, "x\r\n\r\ny", "<p>one</p>"]
    return [(i, f"http://a/{i}\r\nX: y", t) for i, t in enumerate(texts)] + [(None, None, "<p>one</p>"), (None, "u", "only"), (4, "http://again", trap)]


@pytest.mark.parametrize("range_bytes", [64, 700, 8 << 20])
@pytest.mark.parametrize("broadcast_groups", [0, 1000])
def test_warc(spark, range_bytes, broadcast_groups):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"{shared_dir(spark)}/warc"
    warc.typed(pages, broadcast_groups=broadcast_groups).select(warc.record("2024-01-01T00:00:00Z").alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)
    got = Counter(tuple(r) for r in warc.read_archives(spark, folder, range_bytes=range_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    large = {}
    for i, _, t in rows:
        large[t or ""] = max(large.get(t or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, t in rows:
        data, top = (t or "").encode(), large[t or ""]
        revisit = top >= 0 and i != top
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == want


def test_warc_empty_and_damaged(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
    few = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string")
    assert warc.round_trip(few, least_bytes=100).collect()[0].record_type == "response"
    import glob

    folder = f"{shared_dir(spark)}/warc"
    warc.write_archives(few.coalesce(1), folder)
    for path in glob.glob(folder.removeprefix("file://") + "/part-*"):
        data = open(path, "rb").read()
        open(path, "wb").write(data.replace(b"<p>", b"<q>"))
    for path in glob.glob(folder.removeprefix("file://") + "/.*crc"):
        import os

        os.remove(path)
    with pytest.raises(Exception, match="isn't the one"):
        warc.read_archives(spark, folder).count()


def test_rows_far_out_are_set_apart():
    """One huge component leaves the other rows' index small; scores are exact all the same."""
    import numpy as np

    r = np.random.default_rng(3)
    values = r.normal(0, 0.2, (700, 16))
    values[5, 3], values[9, 0] = 1e30, -1e12
    ids = np.arange(700)
    parts = bsi_topk.indexes(ids, values)
    assert [type(x).__name__ for x in parts] == ["SlicedBlock", "FewRows"] and parts[0].bits < 12 and parts[0].values.dtype == np.int64
    assert len(bsi_topk.indexes(ids, values * 1e25)) == 2 and len(bsi_topk.indexes(ids[:3], np.zeros((3, 16)))) == 1
    many = values.copy()
    many[:100] *= 1e9
    assert [type(x).__name__ for x in bsi_topk.indexes(ids, many)] == ["SlicedBlock", "SlicedBlock"]
    query = bsi_topk.whole(values[7])
    found = sorted((x for p in parts for x in zip(*(y.tolist() for y in p.top(query, 7, 5)), strict=True)), key=lambda x: (-x[1], x[0]))[:5]
    exact = sorted(((i, sum(int(a) * int(b) for a, b in zip(bsi_topk.whole(values[i : i + 1]).ravel().tolist(), query.tolist(), strict=True))) for i in range(700) if i != 7), key=lambda x: (-x[1], x[0]))[:5]
    assert found == exact
