"""Quality rules: a decision list learned by sequential covering from labelled documents.

Conjunctions of thresholds over text statistics are grown on one part of the labelled rows by
information gain, pruned on the rest, and put out in order as one Spark conditional expression.

Defined results: a null text has no words and fails the base rule, as an empty one does. Labels with a
null id or quality, or two different qualities for one id, are not used. Rows with one id or text twice
are judged alike, each for itself. With no usable labels the list is empty, and only the base rule
rejects. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gaugeline.llm._common import SPACES, map_columns

SYMBOLS = "#*$%&|<>"
LETTERS, UPPER = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Z\u00c0-\u00d6\u00d8-\u00de]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_bars", "n_distinct_words")

#: What the rules test, as SQL over COUNTS. Ratios hold for texts of any length.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "CAST(n_words AS DOUBLE)",
}


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, free = 0, 0  # free: the first word that no window has counted yet
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, free)
            free = i + 3
    return total


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    seen, repeated, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            repeated += line in seen
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated, repeated_words(words), lines,
        sum(map(len, UPPER.findall(text))), sum(map(len, LETTERS.findall(text))), sum(map(text.count, "0123456789")), text.count("!") + text.count("?"), text.count("|"), len(set(words)),
    )


def count_texts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each document's whole text, in one pass without a shuffle."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in batches:
            yield [ids, *map(list, zip(*map(text_counts, texts), strict=True))]

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); rows that meet it are rejected."""

    tests: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {op} {t!r}D" for f, op, t in self.tests)


def _holds(x: np.ndarray, names: list[str], tests: list[tuple[str, str, float]]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for f, op, t in tests:
        v = x[:, names.index(f)]
        held &= v > t if op == ">" else v <= t
    return held


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int) -> list[tuple[str, str, float]]:
    """Adds the test with the greatest information gain until no good row is left or none gains."""
    tests: list[tuple[str, str, float]] = []
    held = np.ones(len(x), bool)
    while held.any() and (good := held & ~bad).any() and len(tests) < 6:
        p0, n0 = (held & bad).sum(), good.sum()
        if not p0:
            break
        base, best, best_gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for k, f in enumerate(names):
            v = x[held, k]
            values = np.unique(v)
            if len(values) < 2:
                continue
            middles = (values[1:] + values[:-1]) / 2
            if len(middles) > cuts:
                middles = middles[np.linspace(0, len(middles) - 1, cuts).astype(int)]
            order = np.argsort(v, kind="stable")
            sums = np.concatenate([[0], np.cumsum(bad[held][order])])
            at = np.searchsorted(v[order], middles, side="right")
            for op, p, n in (("<=", sums[at], at - sums[at]), (">", p0 - sums[at], len(v) - at - (p0 - sums[at]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), 0)
                if gain.max() > best_gain:
                    best, best_gain = (f, op, float(middles[gain.argmax()])), gain.max()
        if best is None:
            break
        tests.append(best)
        held &= _holds(x, names, [best])
    return tests


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], *, precision: float = 0.9, most: int = 16, cuts: int = 256) -> list[Rule]:
    """Sequential covering over rows x (their order decides the split: two thirds grow, a third prunes)."""
    rules: list[Rule] = []
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most and (left & bad & ~part).sum() >= 3:
        tests = _grow(x[left & ~part], bad[left & ~part], names, cuts)
        worth = lambda t: ((c := _holds(x, names, t) & left & part) & bad).sum() / max(c.sum(), 1) if t else 0  # noqa: E731, B023
        covers = lambda t: (_holds(x, names, t) & left & part & bad).sum() if t else 0  # noqa: E731, B023
        while len(tests) > 1 and (worth(tests[:-1]), covers(tests[:-1])) >= (worth(tests), covers(tests)):
            tests = tests[:-1]
        held = _holds(x, names, tests) & left if tests else np.zeros(len(x), bool)
        right = (held & bad).sum() / max(held.sum(), 1)
        if held.sum() < 3 or right < precision or worth(tests) < precision:
            break
        rules.append(Rule(tuple(tests), int(held.sum()), float(right)))
        left &= ~held
    return rules


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, the same ones each time: those of the smallest hashes."""
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
    )
    return one.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_rules(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, precision: float = 0.9) -> list[Rule]:
    """Rules learned from a sample of at most ``sample_rows`` labelled documents (this bounds what is broadcast and collected)."""
    sample = labelled_sample(labels, sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts, quality in batches:
            yield [ids, quality, *map(list, zip(*map(text_counts, texts), strict=True))]

    counted = map_columns(texts, run, "doc_id long, quality int, " + ", ".join(f"{c} long" for c in COUNTS))
    rows = counted.select("doc_id", "quality", *(F.expr(e).alias(f) for f, e in FEATURES.items())).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample_rows).collect()
    names = list(FEATURES)
    if not rows:
        return []
    return learn_rules(np.array([[float(r[f]) for f in names] for r in rows]), np.array([r["quality"] == 0 for r in rows]), names, precision=precision)


def verdict(rules: list[Rule]) -> Column:
    """False for what the first rule that holds rejects, true for the rest: one CASE expression."""
    out: Column | None = None
    for rule in rules:
        out = F.when(F.expr(rule.sql()), False) if out is None else out.when(F.expr(rule.sql()), False)
    return F.lit(True) if out is None else out.otherwise(True)


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """COUNTS, base_failed and kept for each document."""
    return count_texts(docs).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that the rules keep, whole and with all their columns, in one pass without a shuffle."""
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    @arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def counts(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(k, 500).to_pylist() for k in range(0, len(texts), 500))  # few texts are held as Python strings at once
        return pa.array([dict(zip(COUNTS, text_counts(t), strict=True)) for part in parts for t in part], type=kind)

    names = docs.columns
    inner = docs.select(F.struct(*(docs[c] for c in names)).alias("__row"), counts(docs["text"]).alias("__n")).select("__row", *(F.col("__n")[c].alias(c) for c in COUNTS))
    return inner.where(f"NOT ({BASE_FAILED})").where(verdict(rules)).select("__row.*")
