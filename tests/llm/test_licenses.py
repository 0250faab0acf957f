"""Licence scans: wordings that no template, name or lead holds, wrapped texts, and a brute-force restatement."""

import math
import re
from collections import Counter

from gaugeline.llm import licenses

# Written after the operator was trained, and not used to set anything in it.
UNSEEN = {
    "agpl": ["Hosting this needs respect for the AGPL, version 3.", "Network use obeys the GNU Affero General Public License."],
    "apache": ["Our SDK comes with the Apache License, second version.", "Apache-2.0 covers all examples."],
    "bsd": ["Parts were taken from FreeBSD with their two clause BSD license.", "Subject to BSD-3-Clause."],
    "cc-by": ["Figures: CC BY 4.0, the authors.", "Open access article, Creative Commons Attribution."],
    "cc-by-nc": ["No sale: Creative Commons Attribution-NonCommercial.", "Cite us; CC BY-NC 4.0 holds."],
    "cc-by-sa": ["Maps copyright contributors, CC BY-SA 2.0.", "Share alike: Creative Commons Attribution-ShareAlike 4.0."],
    "cc0": ["To the public domain with CC0 1.0.", "Metadata is CC0."],
    "epl": ["IDE parts carry the Eclipse Public License.", "EPL 2.0 covers this bundle."],
    "gpl": ["Kernel code follows GPL version 2 only.", "Fork it freely, GNU General Public License."],
    "isc": ["Tiny tool, ISC License.", "ISC licence, do what you like."],
    "lgpl": ["Dynamic linking is fine, it's LGPL.", "GNU Lesser General Public License, 2.1 or newer, for the library."],
    "mit": ["(c) 2021 someone. MIT License.", "Everything in this folder: MIT/X11 license."],
    "mpl": ["Browser parts: MPL 2.0.", "Mozilla Public License, as in the root folder."],
    "unlicense": ["I use The Unlicense for this.", "Scripts: Unlicense."],
}
STRANGE = ["Licensed under the Ruby License.", "Distributed under the terms of the Sleepycat License.", "Released under the Vim license.", "This project is available under the Server Side Public License.", "Covered by the Sun Industry Standards Source License.", "License: Nokia Open Source License"]
PROSE = ["The only version of the story that I know is his.", "Terms ended in spring and the library closed.", "Free software was the subject of the talk.", "The public gave its opinion on source and purpose.", "A permit was granted to the merchant, without charge.", "She wrote the text under a lamp."]
WHOLE = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_unseen_wordings_are_told():
    scanner = licenses.train()
    judged = [(f, scanner.license(licenses.tokens(s))) for f, ss in UNSEEN.items() for s in ss]
    assert sum(f == g for f, g in judged) >= 0.9 * len(judged), [x for x in judged if x[0] != x[1]]
    strange = [scanner.license(licenses.tokens(s)) for s in STRANGE]
    assert strange.count(licenses.UNKNOWN) >= 0.8 * len(strange), strange
    assert [scanner.license(licenses.tokens(s)) for s in PROSE].count(licenses.PROSE) >= len(PROSE) - 1


def test_wrapped_lines_are_one_paragraph():
    scanner = licenses.train()
    assert scanner.scan(WHOLE) == (4, 3, 0, ["mit"])
    commented = "\n".join(f" * {line}" for line in WHOLE.split("\n"))
    assert scanner.scan(commented) == (4, 3, 0, ["mit"])
    assert [len(p) for p in licenses.paragraphs("a b\nc\n\n" + "long words of a line that goes on and on\nhere.\n" + "x" * 130 + "\ny")] == [2, 1, 11, 1, 1]


def brute(scanner, text):
    """All word pairs and words of each paragraph, without the anchors' short cut; paragraphs by a pattern."""
    t = re.sub(r"(?m)^[ \t\r\f\v]*[\W_]*?[ \t\r\f\v]*$", "", text or "")
    lines, blocks, go_on = t.split("\n"), [], False
    for line in lines:
        words = re.findall(r"[^\W_]+", line.lower())
        if words:
            blocks[len(blocks) - 1 if go_on else len(blocks) :] = [(blocks[-1] if go_on else []) + words]
        go_on = bool(words) and re.fullmatch(r".{39,119}[^.!?:;]", line.strip(), re.S) is not None
    out = Counter()
    for words in blocks:
        names = {*words, *map(" ".join, zip(words, words[1:], strict=False))}
        z = [b + sum(scanner.weights[g][k] for g in sorted(names) if g in scanner.weights) for k, b in enumerate(scanner.bias)]
        top = max(range(len(z)), key=z.__getitem__)
        name, p = scanner.classes[top], 1 / sum(math.exp(x - z[top]) for x in z)
        if name == licenses.PROSE:
            continue
        own = set(zip(words, words[1:], strict=False))
        sure = name != licenses.UNKNOWN and p >= scanner.bar and (set(words) & scanner.single[name] or any(len(own & t) * 2 >= min(len(own), len(t)) > 0 for t in scanner.pairs[name]))
        out[name if sure else licenses.UNKNOWN] += 1
    return len(blocks), sum(out.values()), out[licenses.UNKNOWN], ",".join(sorted(set(out) - {licenses.UNKNOWN}))


def test_scan_is_the_brute_force_one(spark, odd, none):
    scanner = licenses.train()
    got = Counter(tuple(r) for r in licenses.scan_licenses(odd).collect())
    want = Counter((r.doc_id, *brute(scanner, r.text)) for r in odd.select("doc_id", "text").collect())
    assert got == want
    texts = [*(s for ss in UNSEEN.values() for s in ss), *STRANGE, *PROSE, WHOLE, "\n".join(STRANGE + PROSE), None, "", "---\n***", "x\r\nMIT License\r\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(frame).collect()} == {i: brute(scanner, t) for i, t in enumerate(texts)}
    assert licenses.scan_licenses(none).count() == 0


def test_planted_lines_of_the_documents_are_found(spark):
    """Each document with a planted line has its family; documents without the words of licences have none."""
    planted = {"mit": r"Released under the MIT License\.", "apache": r"Licensed under the Apache License", "cc-by-nc": r"Licensed under CC BY-NC", "gpl": r"GNU General Public License"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    found = 0
    for r in licenses.scan_licenses(docs).collect():
        want = {f for f, p in planted.items() if re.search(p, text[r.doc_id])}
        assert want <= set(filter(None, r.families.split(","))), (r, want)
        found += bool(want)
        if not re.search(r"(?i)licen[sc]e", text[r.doc_id]):
            assert r.n_licensed == 0, r
    assert found > 20
