"""Stops, reasons and refusals of page walks."""

import pytest

from gaugeline.errors import BlankToken, MissingPage, PageCeiling, PaginationError, RepeatedToken
from gaugeline.sources import pages as P

PAGE, ITEM = "run_id string, page_token string, next_token string", "run_id string, page_token string, item int, video_id string"


def chain(run, n, *, last=None, ids=lambda k: [f"v{k}"]):
    tokens = [None, *(f"t{k}" for k in range(1, n))]
    pages = [(run, t, tokens[k + 1] if k + 1 < n else last) for k, t in enumerate(tokens)]
    return pages, [(run, t, i, v) for k, t in enumerate(tokens) for i, v in enumerate(ids(k))]


def stops(spark, *chains, target=500, ceiling=100):
    pages = spark.createDataFrame([p for c in chains for p in c[0]], PAGE).repartition(3)
    items = spark.createDataFrame([i for c in chains for i in c[1]], ITEM).repartition(2)
    return P.stops(spark, pages, items, target=target, ceiling=ceiling)


def test_reasons(spark):
    many = lambda k: [f"{k}-{i}" for i in range(300)]
    found, places = stops(
        spark, chain("done", 3), chain("full", 5, ids=many), chain("back", 4, last="t2"), chain("itself", 2, last="t1"), chain("blank", 2, last=""), chain("gone", 2, last="nowhere"), chain("long", 130), chain("edge", 100),
        chain("late", 3, last="t1", ids=many), chain("same", 3, ids=lambda k: ["a", "", None, "b"][: k + 2]),
    )
    got = {r.run_id: (r.pages, r.stop_token, r.reason, r.n_videos, r.refused) for r in found.collect()}
    assert got == {
        "done": (3, "t2", "source_exhausted", 3, False), "full": (2, "t1", "target_reached", 500, False), "back": (4, "t2", "token_repeated", 4, True), "itself": (2, "t1", "token_repeated", 2, True),
        "blank": (2, "t1", "token_blank", 2, True), "gone": (2, "t1", "page_missing", 2, True), "long": (100, "t99", "page_ceiling", 100, True), "edge": (100, "t99", "source_exhausted", 100, False),
        # What lies behind the target isn't looked at.
        "late": (2, "t1", "target_reached", 500, False), "same": (3, "t2", "source_exhausted", 2, False),
    }
    ids = {r.run_id: [] for r in found.collect()}
    for r in P.collected(found, places).orderBy("run_id", "position").collect():
        ids[r.run_id].append(r.video_id)
    assert ids["done"] == ["v0", "v1", "v2"] and ids["full"] == [*many(0), *many(1)[:200]] and ids["same"] == ["a", "b"]
    assert not ids["back"] and not ids["long"]


@pytest.mark.parametrize(("last", "error"), [("t2", RepeatedToken), ("", BlankToken), ("nowhere", MissingPage)])
def test_refusals_have_classes(spark, last, error):
    found, _ = stops(spark, chain("good", 2), chain("r", 4, last=last))
    with pytest.raises(error) as raised:
        P.assert_stops(found)
    assert isinstance(raised.value, PaginationError) and "r: " in raised.value.parameters["runs"][0]


def test_ceiling_and_twice_landed_pages(spark):
    with pytest.raises(PageCeiling):
        P.assert_stops(stops(spark, chain("r", 9), ceiling=4)[0])
    pages, items = chain("r", 3)
    with pytest.raises(RepeatedToken):
        P.assert_stops(stops(spark, ([*pages, pages[1]], items))[0])
    P.assert_stops(stops(spark, chain("r", 3), ([], []))[0])
