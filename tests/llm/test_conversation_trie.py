"""The trie against a plain one of dictionaries, and running sums against their definition."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gaugeline.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_tasks(spark):
    """Small rows in as many tasks as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rem(c):
    return abs(c) % 5 * (1 if c >= 0 else -1)


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    plain = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in plain:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = plain.get(c - rem(c), [])[:h] + plain[c][h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items())


def rows_of(n, seed, words=4, long=()):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(long[c] if c < len(long) else r.randint(1, 12)):
            out.append((c, t * 3 + 1, r.choice(["user", "assistant"]), f"text {r.randint(0, words)} é"))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "'x' AS depth", "'y' AS a", "7 AS place", "'z' AS level")
    got = ct.trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda x: (x[0], x[1])) == sorted(brute(rows), key=lambda x: (x[0], x[1]))


def test_trie(spark):
    """Nulls, ties, repeated rows, negative ids, missing first conversations and conversations that end where others go on."""
    rows = [x for x in rows_of(60, 1) if x[0] not in (10, 25)]
    rows += [(c, t, r, x) for c, t, r, x in rows if c == 7] + [(8, None, None, None), (8, None, "user", None), (None, 1, "user", "x"), (9, 4, None, "tie"), (9, 4, "", "eit"), (9, 4, None, "tie")]
    rows += [(-c, t, r, x) for c, t, r, x in rows if c and c < 12] + [(1000 + c, 0, "user", "") for c in range(12)]
    check(spark, rows)


def test_long_conversations_and_copies(spark, many_tasks):
    """A conversation and a path over many tasks, and a text that a third of all conversations are."""
    rows = rows_of(40, 2, words=1, long=(700, 700, 3, 900, 700)) + [(5 * c, t, "user", "same") for c in range(100, 160) for t in range(9)]
    check(spark, rows, parts=7)


def test_empty(spark):
    assert ct.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ct.trie(spark.createDataFrame([(None, 1, "u", "t")], SCHEMA)).count() == 0
    check(spark, [(5, 0, "u", "t")])


def test_running_totals(spark, many_tasks):
    r = random.Random(3)
    rows = [(k if k % 3 else 4, i, r.randint(-9, 9), r.getrandbits(63)) for i, k in enumerate(r.choice([1, 2, 3, 4, 50]) for _ in range(4000))]
    df = spark.createDataFrame(rows, "k long, o long, s long, x long").repartition(5)
    got = ct.running(df, ["k"], ["o"], sums=["s"], xors=["x"])
    sums, xors, want = defaultdict(int), defaultdict(int), []
    for k, o, s, x in sorted(rows):
        sums[k] += s
        xors[k] ^= x
        want.append((k, o, sums[k], xors[k]))
    assert sorted(map(tuple, got.collect())) == want
    assert len(got.inputFiles()) > 3


def test_blocks_of_ends_stream_through_the_hash(spark):
    ids = [*range(-5000, 9000, 3), 1 << 40]
    df = spark.createDataFrame([(1, c) for c in ids] + [(2, 7)], "k long, conv_id long").repartition(3)
    got = {r.k: r.ends_sha256 for r in ct.end_digests(df, ["k"]).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}
