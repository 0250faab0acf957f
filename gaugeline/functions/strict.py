"""Strict JSON in expressions: a text is one JSON value and nothing else.

Spark's JSON functions stop after the first value and forgive single quotes. parse_json() forgives no quotes, and what
follows a value is found by putting the text into an array and into an object: a value with anything after it can't be
whole in both, and a comma after it gives the array a second element. Only a text with a closing bracket can end the array
before its own end, so others aren't parsed again. An object that repeats a key is refused too, as it
doesn't say which value counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(text: Column) -> Column:
    """The text as a variant, in an array of one; null if it isn't one JSON value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    # The parse is bound as an array's one element, so that it is made once a text.
    one = lambda v: F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()
    return F.transform(F.array(listed), lambda v: F.when(one(v) & (~F.contains(text, F.lit("]")) | held.isNotNull()), v))[0]


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value; a null isn't."""
    return strict(text).isNotNull()


def kind_at(text: Column, path: str) -> Column:
    """The type of what a strict text holds at the path ('' for all of it): STRING, VOID for null, OBJECT<…>; null if absent."""
    return F.schema_of_variant(F.try_variant_get(strict(text), f"$[0]{path}", "variant"))
