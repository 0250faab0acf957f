"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line with those that continue it: a line of ``WRAPPED`` characters that doesn't end a sentence
is continued by the next unless that has no words, so that hard-wrapped notices are judged whole. A multinomial
logistic regression over sparse word n-grams tells the licence family of a paragraph, or that it is ordinary
prose. It is trained once per process, on variations of the templates and of the families' names within
``LEADS``, and on made-up prose (``TRAINING_ROWS``). The least probability that a prediction needs is calibrated
on held-out variations, with licences left out of the training standing for those that it doesn't know; below
it, or if no template or name of the family shares enough of the paragraph's word pairs, the paragraph's licence
is "unknown". Calibration counts what the templates confirm.

Only n-grams with an anchor, a word that prose hardly has, are features; a paragraph without anchors has
no features and is prose by the same model, which is what makes whole texts quick to scan.

Defined results: a null or empty text has no paragraphs and no licences. Rows are handled each for itself;
a null doc_id is carried; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm._common import map_columns

TRAINING_ROWS = 8000
WRAPPED = (40, 120)  # characters of a line that can be wrapped
ENDS = tuple(".!?:;")
WORDS = re.compile(r"[^\W_]+")
PROSE, UNKNOWN = "none", "unknown"
SHARED = 0.5  # of word pairs, of the shorter of paragraph and template

# Notices and openings of public licences.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "Released under the AGPL-3.0 license."],
    "apache": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache 2.0 license."],
    "bsd": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.', "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Released under CC BY 3.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Released under CC BY-NC 3.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "Released under CC0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.", "Licensed under the Eclipse Public License 2.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program.", "Released under the GPL-3.0 license.", "Licensed under the GNU GPL, version 2."],
    "isc": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.', "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL-2.1 license."],
    "mit": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Released under the MIT License.", "Licensed under the MIT license.", 'The software is provided "as is", without warranty of any kind, express or implied.'],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software for any purpose, commercial or non-commercial, and by any means."],
}
# What the families are called.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero GPL", "GNU AGPL", "AGPL", "AGPL-3.0", "AGPLv3"],
    "apache": ["Apache License", "Apache-2.0", "Apache 2.0", "Apache Software License"],
    "bsd": ["BSD 3-Clause", "BSD 2-Clause", "BSD license", "BSD-style license", "3-clause BSD", "2-clause BSD"],
    "cc-by": ["Creative Commons Attribution", "Creative Commons Attribution License", "CC BY"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial", "CC BY-NC"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike", "CC BY-SA"],
    "cc0": ["CC0", "Creative Commons Zero", "CC0 public domain dedication"],
    "epl": ["Eclipse Public License", "EPL", "EPL-2.0"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL", "GPL-3.0", "GPL-2.0", "GPLv2", "GPLv3"],
    "isc": ["ISC License", "ISC licence terms", "ISC license text"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPL-2.1", "LGPLv3"],
    "mit": ["MIT License", "MIT licence", "MIT/X11 license", "MIT terms", "MIT license text"],
    "mpl": ["Mozilla Public License", "MPL", "MPL-2.0"],
    "unlicense": ["Unlicense", "The Unlicense", "Unlicense public domain"],
}
TAILS = ["", "", "", "1.0", "2.0", "3.0", "4.0", "v2", "v3", "version 2", "version 3", "license", "licence", "only", "terms"]
OTHER_NAMES = ["Artistic License 2.0", "Zope Public License", "European Union Public Licence", "Boost Software License", "Python Software Foundation License", "proprietary license", "custom licence", "house license terms"]
LEADS = ["{}", "Licensed under the {}.", "Released under {}.", "Distributed under the terms of the {}.", "This project is available under the {}.", "See the {} for details.", "SPDX-License-Identifier: {}", "The code in this repository is covered by the {}.", "License: {}", "You can use it under the {}."]
# Licences that stand for unknown ones (the last three for calibration only), and prose that shares words with licences.
OTHERS = ["Licensed under the Artistic License 2.0.", "Released under the terms of the Zope Public License.", "All rights reserved. Proprietary license, do not distribute.", "Licensed under the European Union Public Licence, version 1.2.", "Released under the Boost Software License.", "This material is licensed under the Open Government Licence v3.0.", "Use is subject to the Microsoft Public License.", "Licensed under the Academic Free License 3.0."]
ORDINARY = ["He lost his driving license on the way to work.", "You need permission to enter the building after hours.", "The software was released in spring to the general public.", "The committee shall discuss the terms of the agreement.", "A copy of the report is available at the front desk.", "The source of the river lies in the mountains.", "The public library is free for any person in town.", "We use commercial flights when the conditions are met.", "The apache helicopter landed near the eclipse viewing site.", "She studied at MIT and wrote a thesis on artificial grammar.", "The warranty covers parts and labor for two years.", "Distribution of the goods without a fee is not the rule."]
STOP = frozenset("a an and any are as at be by can for from has have he her his if in is it its not of on or our shall she that the their this to was we were which with you your".split())


def tokens(paragraph: str) -> list[str]:
    return WORDS.findall(paragraph.lower())


@dataclass(frozen=True)
class Scanner:
    """A trained classifier: weights of n-grams for each class, the biases, anchors, the bar and the templates' word pairs."""

    classes: tuple[str, ...]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    anchors: frozenset[str]
    bar: float
    pairs: dict[str, list[frozenset[tuple[str, str]]]]
    single: dict[str, frozenset[str]]

    def classify(self, words: list[str]) -> tuple[str, float]:
        """The class of a paragraph and its probability, before confirmation."""
        z = self.bias.copy()
        for gram in grams(words, self.anchors):
            if (w := self.weights.get(gram)) is not None:
                z += w
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.classes[k], float(p[k])

    def license(self, words: list[str]) -> str:
        if self.anchors.isdisjoint(words):
            return PROSE
        name, p = self.classify(words)
        if name == PROSE:
            return PROSE
        if name == UNKNOWN or p < self.bar:
            return UNKNOWN
        return name if self.confirms(name, words) else UNKNOWN

    def confirms(self, name: str, words: list[str]) -> bool:
        """Whether a template of the family shares enough word pairs with the paragraph, or a name of one word is in it."""
        own = frozenset(zip(words, words[1:], strict=False))
        return not self.single[name].isdisjoint(words) or bool(own) and any(len(own & t) >= SHARED * min(len(own), len(t)) for t in self.pairs[name])

    def scan(self, text: str | None) -> tuple[int, int, int, list[str]]:
        """How many paragraphs a text has, how many state a licence, how many of these are unknown, and the families."""
        n, known = 0, Counter()
        for words in paragraphs(text or ""):
            n += 1
            if (name := self.license(words)) != PROSE:
                known[name] += 1
        return n, sum(known.values()), known[UNKNOWN], sorted(set(known) - {UNKNOWN})


def paragraphs(text: str) -> Iterator[list[str]]:
    """The words of each paragraph that has some."""
    open_words: list[str] = []
    for line in text.split("\n"):
        words, line = tokens(line), line.strip()
        open_words += words
        if open_words and not (words and WRAPPED[0] <= len(line) <= WRAPPED[1] and not line.endswith(ENDS)):
            yield open_words
            open_words = []
    if open_words:
        yield open_words


def grams(words: list[str], anchors: frozenset[str]) -> set[str]:
    """Single words and pairs of neighbours that hold an anchor, each once."""
    held = [w in anchors for w in words]
    out = {w for w, h in zip(words, held, strict=True) if h}
    out.update(f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if held[i] or held[i + 1])
    return out


def _varied(r: random.Random, sentence: str) -> list[str]:
    words = tokens(sentence)
    if len(words) > 8 and r.random() < 0.4:
        size = r.randint(max(6, len(words) // 2), len(words))
        at = r.randint(0, len(words) - size)
        words = words[at : at + size]
    words = [w for w in words if len(words) < 7 or r.random() > 0.04]
    return _framed(r, words)


def _framed(r: random.Random, words: list[str]) -> list[str]:
    head, tail = ([_syllables(r) for _ in range(r.choice([0, 0, 0, 1, 3, 8]))] for _ in range(2))
    return head + words + tail


def _strange(r: random.Random) -> str:
    """The name of a licence that there isn't."""
    return " ".join([*(_syllables(r) for _ in range(r.randint(1, 2))), *r.sample(["open", "public", "software", "free", "source"], r.randint(0, 2)), r.choice(["license", "licence", "terms"])])


def _syllables(r: random.Random) -> str:
    return "".join(r.choice(["th", "er", "on", "an", "re", "en", "ti", "es", "or", "ou", "ha", "in", "ed", "al", "ir", "om"]) for _ in range(r.randint(1, 4)))


@cache
def train(*, rows: int = TRAINING_ROWS, seed: int = 11, steps: int = 250, right: float = 0.98) -> Scanner:
    """The same arguments give the same classifier."""
    r = random.Random(seed)
    classes = (*TEMPLATES, UNKNOWN, PROSE)
    common = Counter(w for s in ORDINARY for w in set(tokens(s)))
    anchors = frozenset(w for ts in (*TEMPLATES.values(), *NAMES.values(), OTHERS, OTHER_NAMES, LEADS, TAILS) for t in ts for w in tokens(t) if w not in STOP and not w.isdigit() and common[w] < 2)
    data: list[tuple[list[str], str]] = []
    for k in range(rows):
        name = classes[k % len(classes)]
        called = NAMES.get(name) or (OTHER_NAMES if name == UNKNOWN else [])
        if called and r.random() < 0.5:
            sentence = r.choice(LEADS).format(_strange(r) if name == UNKNOWN and r.random() < 0.5 else f"{r.choice(called)} {r.choice(TAILS)}")
            data.append((_framed(r, tokens(sentence)), name))
        else:
            source = TEMPLATES.get(name) or (OTHERS[:5] if name == UNKNOWN else ORDINARY)
            data.append((_varied(r, r.choice(source)), name))
    for _ in range(rows // 5):
        body = [_syllables(r) for _ in range(r.randint(3, 40))]
        if r.random() < 0.5:
            body.insert(r.randrange(len(body)), r.choice(sorted(anchors)))
        data.append((body, PROSE))
    held = [r.random() < 0.25 for _ in data]
    fitted = [d for d, h in zip(data, held, strict=True) if not h]
    counts = Counter(g for words, _ in fitted for g in grams(words, anchors))
    names = sorted(g for g, n in counts.items() if n >= 2)
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(fitted), len(names)), np.float32)
    for i, (words, _) in enumerate(fitted):
        x[i, [place[g] for g in grams(words, anchors) if g in place]] = 1
    y = np.zeros((len(fitted), len(classes)), np.float32)
    y[np.arange(len(fitted)), [classes.index(c) for _, c in fitted]] = 1
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    pace, drift = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pace = 0.9 * pace + x.T @ (p - y) / len(x) + 3e-5 * w
        drift = 0.9 * drift + (p - y).mean(0)
        w -= 1.0 * pace
        b -= 0.1 * drift
    pairs = {c: [p for t in map(tokens, (*ts, *NAMES[c])) if (p := frozenset(zip(t, t[1:], strict=False)))] for c, ts in TEMPLATES.items()}
    single = {c: frozenset(t[0] for t in map(tokens, NAMES[c]) if len(t) == 1) for c in TEMPLATES}
    open_bar = Scanner(classes, dict(zip(names, w.astype(float), strict=True)), b.astype(float), anchors, 0.0, pairs, single)
    strange = [(_varied(r, s), UNKNOWN) for s in OTHERS[5:] for _ in range(20)]
    judged = [(*open_bar.classify(words), words, c) for words, c in [d for d, h in zip(data, held, strict=True) if h] + strange]
    scored = sorted(((p, name == c) for name, p, words, c in judged if name not in (PROSE, UNKNOWN) and open_bar.confirms(name, words)), reverse=True)
    bar, good = 1.0, 0
    for n, (p, ok) in enumerate(scored, 1):
        good += ok
        if good >= right * n:
            bar = p
    return Scanner(classes, open_bar.weights, open_bar.bias, anchors, bar, pairs, single)


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, n_unknown and families (sorted, joined by commas) of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(scanner or train())

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        own = held.value
        for ids, texts in batches:
            rows = [own.scan(t) for t in texts]
            yield [ids, *([r[k] for r in rows] for k in range(3)), [",".join(r[3]) for r in rows]]

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_paragraphs long, n_licensed long, n_unknown long, families string")
