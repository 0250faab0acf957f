"""Personal data: candidate spans, boosted trees and calibrated thresholds, as DataFrame expressions only.

The base rules (e-mail, IP, card and phone patterns with their checks) always hold. Besides, generators of
high recall propose spans, overlapping ones too: grouped or joined card numbers, local phone numbers,
spelt-out addresses, IPv6, social security numbers and secrets. Boosted trees over the form of a candidate
and the words before it give each a score; thresholds for each kind, calibrated on held-out rows, choose.
The trees are trained once per process, on a fixed number of made-up sentences (``TRAINING_ROWS``).

Spans are code points, the end exclusive. Patterns use possessive repeats and look-behind instead of
backtracking, so that a run of any length costs linear time and no stack.

Defined results: a null text counts as an empty one and has no spans; ``redacted`` leaves it null. Rows are
handled each for itself; extra columns are ignored by ``find`` and kept by ``redacted``.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import boosting

KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
TRAINING_ROWS = 3000

# Each pattern matches what the plain one in its comment does, leftmost and without overlap: \G lets a match
# begin where the last one ended, and elsewhere only the first place of a run of its characters can be the leftmost.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"rlike({t}, '[0-9][.][0-9]')"),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"rlike({t}, '[0-9][0-9 -]{{4}}')"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')"),
}
GENERATORS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?i:dot)[\])]) ?[A-Za-z0-9-]{1,63})++", r"rlike({t}, '(?i)[\\[(]at[\\])]')"),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"rlike({t}, '[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:[0-9A-Fa-f]')"),
    "card": (r"(?<![0-9])(?:[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}|[0-9]{13,19})(?![0-9])", r"rlike({t}, '[0-9][0-9 .-]{{12}}')"),
    "phone": (r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", r"rlike({t}, '[0-9]{{3}}[ .-][0-9]{{4}}')"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"rlike({t}, '[0-9]-[0-9]{{2}}-[0-9]')"),
    "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}", r"rlike({t}, '[0-9][A-Za-z0-9_-]{{7}}')"),
}
BEFORE = 40  # characters before a candidate that are looked at
# Words before a candidate that tell something: secrets, telephones, numbers of persons, cards; and, as whole words, what isn't personal.
WORDS = (r"token|secret|passw|api.?key|apikey|auth|credential|bearer|private", r"call|phone|tel|mobile|fax|contact|cell", r"ssn|social|security", r"card|visa|credit|debit|payment", r"(?<![a-z])(?:commit|sha|md5|hash|digest|checksum|order|invoice|isbn|version|serial|part|sku|tracking|uuid|build|id|no\.|ref|reference)(?![a-z])")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value taken once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(lengths: Column, sizes: Column, n: Column) -> Column:
    """Where each match starts: sums of what is before it, by blocks of 256, so the cost isn't the square of n."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    block = F.lit(256)
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(sizes, b * block + 1, block)))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(starts, lambda s: F.transform(lengths, lambda gap, i: s[F.floor(i / block).cast("int")] + total(F.slice(sizes, F.floor(i / block).cast("int") * block + 1, i % block)) + gap))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>> of the pattern's matches in text, left to right."""

    def of(found: Column) -> Column:
        def placed(both: Column) -> Column:
            lengths = F.transform(F.slice(both, 1, F.size(found)), lambda x: x["gap"])
            sizes = F.transform(F.slice(both, 1, F.size(found)), lambda x: x["gap"] + x["long"])
            return let(F.struct(lengths.alias("g"), sizes.alias("s")), lambda v: F.zip_with(_running(v["g"], v["s"], F.size(found)), found, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("found"))))

        gaps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("long")))
        return F.when(F.size(found) == 0, F.expr(NO_SPANS_SQL)).otherwise(let(gaps, placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


NO_SPANS_SQL = "CAST(array() AS array<struct<start:int,end:int,found:string>>)"


def guarded(text: Column, name: str, pattern: str, guard: str) -> Column:
    """spans() for the texts that could hold a match; ``name`` is text's name in SQL."""
    return F.when(F.expr(guard.format(t=name)), spans(text, pattern)).otherwise(F.expr(NO_SPANS_SQL))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    return let(F.reverse(number), lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + let(F.substring(r, i, F.lit(1)).cast("int") * (2 - i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d))) % 10 == 0)


def holds(kind: str, found: Column) -> Column:
    """The base rule's check of a match."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").cast("string").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits(found), lambda d: F.length(d).between(13, 19) & luhn(F.when(F.length(d).between(13, 19), d).otherwise("1")))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, name: str) -> Column:
    """array<struct<kind,start,end>> of the base rules, by kind and start."""
    def one(n: int, kind: str) -> Column:
        right = F.filter(guarded(text, name, *BASE[kind]), lambda s: holds(kind, s["found"]))
        return F.transform(right, lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*(one(n, k) for n, k in enumerate(KINDS) if k in BASE))


def features(text: Column, kind: int, s: Column) -> Column:
    """What the trees see of a candidate: its kind, its form and the words before it."""
    found, flag = s["found"], lambda c: c.cast("double")
    before = F.lower(F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))))
    number = digits(found)
    return F.array(
        F.lit(float(kind)), F.length(found).cast("double"), F.length(number).cast("double"), F.length(F.regexp_replace(found, "[^A-Za-z]", "")).cast("double"),
        flag(luhn(F.when(F.length(number).between(13, 19), number).otherwise("1"))), flag(found.rlike("[a-z]") & found.rlike("[A-Z]")),
        flag(found.rlike("^[0-9a-fA-F]+$")), F.size(F.array_distinct(F.split(found, ""))).cast("double"), flag(before.rlike("[\"'=:]\\s*[\"']?$")),
        *(flag(before.rlike(w)) for w in WORDS),
    )


def candidates(text: Column, name: str) -> Column:
    """array<struct<kind,start,end,x>> of all generators, x being the features."""
    def one(n: int, kind: str) -> Column:
        proposed = guarded(text, name, *GENERATORS[kind])
        if kind == "secret":
            proposed = F.filter(proposed, lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))
        return F.transform(proposed, lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(text, n, s).alias("x")))

    return F.concat(*(one(n, k) for n, k in enumerate(KINDS)))


def _luhn_number(r: random.Random, n: int, right: bool) -> str:
    while True:
        d = [r.randrange(10) for _ in range(n)]
        total = sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d)))
        if (total % 10 == 0) == right:
            return "".join(map(str, d))


def made_up(rows: int, seed: int = 7) -> list[tuple[int, str, int, int, int]]:
    """(id, text, start, end, kind) of sentences; kind is -1 where what stands at start only looks like personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ae io uon th re st an er".split()) for _ in range(r.randint(1, 4)))
    text = lambda: " ".join(word() for _ in range(r.randint(2, 7)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(n))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    by4 = lambda s, c: c.join(s[k : k + 4] for k in range(0, 16, 4))
    forms: list[Callable[[], tuple[str, str, str, int]]] = [
        lambda: (r.choice(["token = ", "api_key: ", "secret=", "password = ", "auth token ", "Bearer "]), r.choice(['"', "'", ""]), r.choice([hexa(32), hexa(40), mixed(24), mixed(36)]), 5),
        lambda: (r.choice(["commit ", "sha1 ", "md5: ", "checksum ", "build ", "uuid ", "", "file "]), "", r.choice([hexa(32), hexa(40), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", f"{word()}-{word()}-{word()}-{num(3)}-{word()}{word()}"]), -1),
        lambda: (r.choice(["", "card ", "visa ", "payment with "]), "", r.choice([by4(_luhn_number(r, 16, True), r.choice(" -.")), _luhn_number(r, r.choice([13, 15, 16, 16, 19]), True)]), 2),
        lambda: (r.choice(["", "order ", "invoice ", "tracking no. ", "serial ", "card "]), "", r.choice([by4(_luhn_number(r, 16, False), r.choice(" -.")), _luhn_number(r, r.choice([13, 14, 16, 18]), False)]), -1),
        lambda: (r.choice(["", "call ", "phone: ", "tel. ", "fax "]), "", r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]), 3),
        lambda: (r.choice(["part ", "sku ", "isbn ", "ref ", "version "]), "", r.choice([f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}"]), -1),
        lambda: (r.choice(["ssn ", "social security number ", "SSN: "]), "", f"{num(3)}-{num(2)}-{num(4)}", 4),
        lambda: (r.choice(["part ", "sku ", "", "serial ", "order "]), "", f"{num(3)}-{num(2)}-{num(4)}", -1),
        lambda: (r.choice(["mail ", "write to ", ""]), "", f"{word()}.{word()}{r.choice([' [at] ', '(at)', ' (AT) '])}{word()}{r.choice([' [dot] ', '(dot)', '.'])}com", 0),
        lambda: (r.choice(["host ", "from ", ""]), "", ":".join(hexa(r.randint(1, 4)) for _ in range(8)), 1),
    ]
    out = []
    for k in range(rows):
        lead, quote, body, kind = forms[k % len(forms)]()
        head = f"{text()} {lead}{quote}"
        out.append((k, f"{head}{body}{quote} {text()}", len(head), len(head) + len(body), kind))
    return out


_trained: dict[tuple[int, float], tuple[boosting.Boosted, list[float]]] = {}


def train(spark: SparkSession, *, rows: int = TRAINING_ROWS, precision: float = 0.97) -> tuple[boosting.Boosted, list[float]]:
    """The trees, fitted on two thirds of the made-up sentences, and each kind's threshold, calibrated on the rest.

    The same numbers give the same trees, which are kept for the next call."""
    if (rows, precision) not in _trained:
        _trained[rows, precision] = _fit(spark, rows, precision)
    return _trained[rows, precision]


def _fit(spark: SparkSession, rows: int, precision: float) -> tuple[boosting.Boosted, list[float]]:
    truth = made_up(rows)
    frame = spark.createDataFrame([(k, t) for k, t, *_ in truth], "k int, text string")
    got = frame.select("k", F.explode(candidates(F.col("text"), "text")).alias("c")).select("k", "c.*").collect()
    real = {(k, kind, a, z) for k, _, a, z, kind in truth}
    got.sort(key=lambda g: (g["k"], g["kind"], g["start"]))
    x, y = np.array([g["x"] for g in got]), np.array([float((g["k"], g["kind"], g["start"], g["end"]) in real) for g in got])
    held, kinds = np.array([g["k"] // 10 % 3 == 2 for g in got]), np.array([g["kind"] for g in got])
    model = boosting.fit(x[~held], y[~held])
    margins = model.margin(x[held])
    return model, [boosting.threshold(margins[kinds[held] == n], y[held][kinds[held] == n], precision) for n in range(len(KINDS))]


def found(docs: DataFrame, model: boosting.Boosted, thresholds: list[float]) -> DataFrame:
    """docs with __base and __spans, arrays of (kind, start, end), by kind, start and end; all base spans are in both."""
    one = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    two = one.withColumn("__base", base_spans(F.col("__t"), "__t")).withColumn("__candidates", candidates(F.col("__t"), "__t"))
    bar = "CASE c.kind " + " ".join(f"WHEN {n} THEN {t!r}D" if t != float("inf") else f"WHEN {n} THEN 1e300D" for n, t in enumerate(thresholds)) + " END"
    added = F.expr(f"filter(__candidates, c -> NOT exists(__base, b -> b.start < c.end AND c.start < b.end) AND {model.sql('c.x')} >= {bar})")
    every = F.array_sort(F.array_distinct(F.concat("__base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))))
    return two.withColumn("__spans", every).drop("__candidates")


def written_spans(spans_column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find(docs: DataFrame, model: boosting.Boosted, thresholds: list[float]) -> DataFrame:
    """doc_id, how many base spans of each kind, the digest of the base spans and all spans of each document."""
    got = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, thresholds)
    count = lambda n: F.size(F.filter("__base", lambda s: s["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS) if k in BASE]
    return got.select("doc_id", *counts, F.sha2(written_spans("__base"), 256).alias("base_sha256"), written_spans("__spans").alias("spans"))


def redacted(docs: DataFrame, model: boosting.Boosted, thresholds: list[float]) -> DataFrame:
    """docs with [KIND] in the place of each span in text; spans that overlap become one, named after the first."""
    names = docs.columns
    own = docs.select(F.struct(*(F.col(c) for c in names)).alias("__whole"), "text")
    got = found(own, model, thresholds)
    by_start = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = F.aggregate(
        by_start,
        F.expr("CAST(array() AS array<struct<start:int,end:int,kind:int>>)"),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] < F.element_at(a, -1)["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"), F.element_at(a, -1)["kind"].alias("kind"))))).otherwise(F.concat(a, F.array(s))),
    )
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def rebuilt(m: Column) -> Column:
        end = lambda i: F.when(i == 0, 0).otherwise(m[i - 1]["end"])
        parts = F.transform(m, lambda s, i: F.concat(F.substring(F.col("__t"), end(i) + 1, s["start"] - end(i)), tags[s["kind"]]))
        return F.concat(F.array_join(parts, ""), F.substring(F.col("__t"), F.element_at(m, -1)["end"] + 1, F.length("__t")))

    text = F.when(F.size("__spans") == 0, F.col("text")).otherwise(let(joined, rebuilt))
    done = got.withColumn("__redacted", text)
    return done.select(*(F.col("__redacted").alias(c) if c == "text" else F.col("__whole")[c].alias(c) for c in names))
