"""The locator scan against a plain one that walks over each line character by character."""

import random
import re

import pytest

from gaugeline.operators import locators as L

WORD = re.compile(r"\b(?:lines?|linhas?)\s+", re.I)


def runs_of(line):
    """(start, stop, count, colon) of each run, found by trying every place in turn."""
    item, sep, at = re.compile(L.ITEM), re.compile(L.SEPARATOR), 0
    while at < len(line):
        colon = line[at] == ":"
        word = None if colon else WORD.match(line, at)
        first = item.match(line, at + 1) if colon else item.match(line, word.end()) if word else None
        if first is None:
            at += 1
            continue
        stop, n = first.end(), 1
        while (s := sep.match(line, stop)) and (not colon or line[s.end() : s.end() + 1] == ":") and (more := item.match(line, s.end() + colon)):
            stop, n = more.end(), n + 1
        yield at, stop, n, colon
        at = stop


def brute(text):
    out = []
    for number, line in enumerate((text or "").splitlines(), 1):
        quotes = [m.span() for m in re.finditer(L.QUOTATION, line)]
        for start, stop, n, colon in runs_of(line):
            paths = [m[0] for m in re.finditer(L.PATH, line) if m.end() <= start]
            if (colon and not paths) or any(a <= start and stop <= b for a, b in quotes):
                continue
            low, high = max(0, start - L.WINDOW), min(len(line), stop + L.WINDOW)
            durable = any(a < high and b > low for a, b in quotes) or re.search(L.ANCHOR, line[low:high])
            kind = L.KIND_ENUMERATION if n >= L.ENUMERATION else None if durable else L.KIND_BARE
            if kind:
                out.append((number, start + 1, kind, paths[-1] if paths else L.UNNAMED, line[start:stop].strip()))
    return out


def scan(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id int, text string, line_no string").drop("line_no").repartition(3)
    found = {}
    for r in L.findings(df).collect():
        found.setdefault(r.id, []).append(tuple(r)[1:])
    return [sorted(found.get(k, [])) for k in range(len(texts))]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("see a/b.md:12", [(1, 11, L.KIND_BARE, "a/b.md", ":12")]),
        ("no path :12, 09:45", []),
        ("lines 40, 128, 384 and 790", [(1, 1, L.KIND_ENUMERATION, L.UNNAMED, "lines 40, 128, 384 and 790")]),
        ('x.py:1 "as it says here"', []),
        ('x.py "lines 4 and 9 of it" y', []),
        ("x.py:1-4 and :9 § 3", []),
        ("x.py:1, :2; :3 § 3", [(1, 5, L.KIND_ENUMERATION, "x.py", ":1, :2; :3")]),
        ("x.py:5" + " " * 239 + "D4", [(1, 5, L.KIND_BARE, "x.py", ":5")]),
        ("x.py:5" + " " * 238 + "D4", []),
        ("x.py:5" + " " * 240 + "D4", [(1, 5, L.KIND_BARE, "x.py", ":5")]),
        ("a.py\nb.ts:7\r\nLinha 3", [(2, 5, L.KIND_BARE, "b.ts", ":7"), (3, 1, L.KIND_BARE, L.UNNAMED, "Linha 3")]),
        ("a.py:1 \x01:2\x02 :3", None),
        (None, []),
        ("", []),
    ],
)
def test_rules(spark, text, found):
    got = scan(spark, [text])[0]
    assert got == sorted(brute(text and text.replace("\x01", "\x03").replace("\x02", "\x03")))
    if found is not None:
        assert got == found


def test_scan_is_brute_force(spark):
    r = random.Random(6)
    parts = [" ", " ", "a.md", "x/y.py", ":12", ":3-9", ":7 – :9", ", ", " and ", "; ", " e ", "lines 4", "line ", "linhas 8", "12", '"', "“", "”", "quoted text here", "§ 2", "D7", "items 4", "row ", "Annex B", "\n", " ", "é", "日本", "x" * 100, "word " * 30, "8:45"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts.append("see a.md " + ":4, :5 x " * 400)
    assert scan(spark, texts) == [sorted(brute(t)) for t in texts]


def test_whole_documents(spark):
    from gaugeline.plans import adapter as A
    from gaugeline.plans import queries as Q

    got = {}
    for r in Q.locator_findings(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    texts = {r.doc_id: r.text for r in A.relation(spark, "/root/testdata/sf0.001", Q.CITING).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(found) for k, t in texts.items() if (found := brute(t))}
    assert len(got) > 20
