"""Operator 3 takes its words from the passes of a mix that is really laid out."""

from collections import defaultdict

import pytest

from gaugeline.llm import mixing
from gaugeline.llm.queries import QUERIES

D = "/root/testdata/sf0.001"


def test_op3_goes_through_the_sorted_mix(spark, monkeypatch):
    made = []
    monkeypatch.setattr(mixing, "written", lambda df, name, own=mixing.written: made.append(own(df, name)) or made[-1])
    got = QUERIES["op3_mixing"](spark, D).collect()
    laid = [r for r in made[-1].collect() if r["__position"] is not None]
    assert {r["__pass"] for r in laid} == {0, 1}
    words = defaultdict(int)
    for r in laid:
        words[r.doc_id] += r["__words"]
    assert {r.doc_id: r.taken for r in got if r.taken} == words


def test_all_passes_have_their_positions(spark, odd):
    rows = mixing.passes(odd).collect()
    at = [r["__position"] for r in rows if r["__position"] is not None]
    assert len(at) > 20 and at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    got = mixing.mix(odd).collect()
    assert sorted(x for r in got for x in r.positions) == pytest.approx(at)
    assert all(r.first_position == (r.positions[0] if r.positions else None) for r in got)
    assert any(len(r.positions) == 2 for r in got)


def test_schedules_decide_when_documents_come(spark, odd, monkeypatch):
    before = {(r.doc_id, r.source, r.size, r.first_position) for r in mixing.mix(odd).collect()}
    monkeypatch.setattr(mixing, "SCHEDULES", tuple(((0.0, 0.1), (1.0, 2.0)) for _ in mixing.SCHEDULES))
    after = {(r.doc_id, r.source, r.size, r.first_position) for r in mixing.mix(odd).collect()}
    assert len(after - before) > len(after) / 2


def test_rows_without_an_id_are_spread(spark):
    """And ranges are as many as the rows need."""
    docs = spark.createDataFrame([(None, f"some text number {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    sized = docs.select("source", mixing.word_count(docs["text"]).alias("size"), mixing.order_hash(docs["doc_id"], docs["text"]).alias("__hash"))
    few, many = mixing.placed(sized, 3000), mixing.placed(sized, 3 * 256 * mixing.RANGE_ROWS)
    assert few.select("__range").distinct().count() == 256 and many.select("__range").distinct().count() > 1000
    assert {r["__start"] for r in few.collect()} == {r["__start"] for r in many.collect()} == set(range(0, 12_000, 4))
