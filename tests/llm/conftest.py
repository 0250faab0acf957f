import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("th er on an re en ti es or ou ha in ed".split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies and shared passages."""
    r = random.Random(5)
    passage, long = words(r, 40), words(r, 30_000)
    some = [words(r, r.randint(5, 120)) for _ in range(12)]
    near = some[3].split(" ")
    near[2] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", *some, some[0], some[0], some[1].upper(), " ".join(near), f"{words(r, 30)} {passage} {words(r, 20)}", f"{passage}\n{words(r, 30)}", f"{words(r, 9)} {passage}", long, long[:-20], "the the the the " * 60, "a\n\nb\nb\nb\n  b\x0b\x0c c", "Été 日本 \U0001f642 <|endoftext|> ▁x\u0000 <s>", "x" * 5000, "+1 (415) 555-0199, a.b@c.de 10.0.0.1 and 4111 1111 1111 1111"]
    rows = [(i, t, "en", ["s1", "s0", None][i % 3], len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, (None, some[2], None, None, None), (None, passage, None, "s1", None), (7, some[2], "en", "s0", 1), rows[8], rows[8]]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    clashing = ("size", "ids", "decoded", "fp", "key", "place", "words", "starts", "n_words", "kept", "base_failed", "taken", "target", "turn", "token", "quality", "digest", "component_id")
    return df.withColumns({c: F.lit(f"x{c}") for c in clashing})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
