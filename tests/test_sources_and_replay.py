"""Landed bodies, write-once runs, ledgers, replay and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeline.errors import BodyError, IntegrityViolation, NotNullViolation, typed_errors
from gaugeline.operators import gates, replay
from gaugeline.sources import raw
from gaugeline.streaming import quota


def bodies(spark, *values):
    return spark.createDataFrame([("r", json.dumps(v)) for v in values], "run_id string, body string")


def video(**stats):
    return {"kind": "youtube#video", "id": "v", "snippet": {"channelId": "c", "title": "t", "publishedAt": "2026-06-01T00:00:00Z"}, "statistics": stats}


def test_projection_keeps_null_from_zero(spark):
    got = raw.project_videos(bodies(spark, video(viewCount="0"), video(likeCount="12"))).orderBy("views").collect()
    assert [(x.views, x.likes, x.comments) for x in got] == [(None, 12, None), (0, None, None)]


def but(**changed):
    return {**video(), **changed}


@pytest.mark.parametrize("body", [video(viewCount="many"), but(snippet={}), but(id=None), but(id=5), but(kind="video"), but(kind=None), but(headers={}), but(snippet={"channelId": "c", "title": 5}), but(snippet={"channelId": "c", "publishedAt": 7})])
def test_projection_fails_closed(spark, body):
    with pytest.raises(BodyError), typed_errors():
        raw.project_videos(bodies(spark, body)).collect()


@pytest.mark.parametrize("changed", [{}, {"kind": "youtube#video"}, {"key": "k"}, {"snippet": {"title": ["x"]}}, {"id": ""}])
def test_channel_projection_fails_closed(spark, changed):
    whole = {"kind": "youtube#channel", "id": "c", "snippet": {"title": None}, "statistics": {"videoCount": "0"}}
    rows = raw.project_channels(bodies(spark, {**whole, **changed}))
    if changed:
        with pytest.raises(BodyError), typed_errors():
            rows.collect()
    else:
        assert rows.first().asDict() == {"run_id": "r", "channel_id": "c", "title": None, "subscriber_count": None, "view_count": None, "upload_count": 0}


def test_transport_keys(spark):
    got = bodies(spark, {"key": 1}, {"items": [{"key": 1}]}, {"config": None}).select(raw.carries_transport(F.col("body")).alias("x")).collect()
    assert [x.x for x in got] == [True, False, True]


def test_runs_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "v")], "run_id string, video_id string")
    raw.write_run(rows, f"{tmp_path}/t/run_id=r1")
    with pytest.raises(IntegrityViolation):
        raw.write_run(rows, f"{tmp_path}/t/run_id=r1")
    assert raw.new_rows(rows.union(rows), rows.limit(0), ["run_id", "video_id"]).count() == 1
    assert raw.new_rows(rows, rows, ["run_id", "video_id"]).count() == 0
    assert raw.run_scan(spark, f"{tmp_path}/t", "r1").count() == 1
    assert replay.freeze(rows, f"{tmp_path}/frozen").collect() == rows.collect()
    with pytest.raises(IntegrityViolation):
        replay.freeze(rows, f"{tmp_path}/frozen")


def test_pagination(spark):
    pages = spark.createDataFrame([("r", None, "a"), ("r", "a", "b"), ("r", "b", None), ("loop", None, "x"), ("loop", "x", "x")], "run_id string, page_token string, next_token string")
    walk = raw.token_chain(spark, pages, 10)
    assert [(x.page_token, x.step) for x in walk.where("run_id = 'r'").orderBy("step").collect()] == [(None, 1), ("a", 2), ("b", 3)]
    assert [x.page_token for x in gates.unvisited_pages(pages, walk).collect()] == ["x"]
    items = spark.createDataFrame([("r", 1, 0, "b"), ("r", 0, 1, "a"), ("r", 0, 0, "b"), ("r", 1, 1, "c")], "run_id string, page int, item int, video_id string")
    assert [x.video_id for x in raw.first_unique(items, 2).orderBy("position").collect()] == ["b", "a"]


def test_long_chain(spark):
    """999 pages of one run, and a token that leads back."""
    pages = [("r", f"t{k}" if k else None, f"t{k + 1}" if k < 998 else None) for k in range(999)] + [("back", None, "x"), ("back", "x", "x")]
    walk = raw.token_chain(spark, spark.createDataFrame(pages, "run_id string, page_token string, next_token string").repartition(2), 1000)
    steps = [(x.run_id, x.page_token, x.step) for x in walk.collect()]
    assert sorted(s for r, _, s in steps if r == "r") == list(range(1, 1000)) and ("r", "t700", 701) in steps
    assert sorted(s for r, _, s in steps if r == "back") == list(range(1, 1001))


def test_refused_charges_spend_nothing(spark):
    """Later charges are judged by what was really spent, and a refused retry doesn't stop what isn't one."""
    rows = [("r", 1, 1950, False), ("r", 2, 100, False), ("r", 3, 1, False), ("s", 1, 500, True), ("s", 2, 1, True), ("s", 3, 1500, False), ("s", 4, 1, False)]
    got = raw.quota_ledger(spark.createDataFrame(rows[::-1], "run_id string, seq int, units int, is_retry boolean")).orderBy("run_id", "seq").collect()
    assert [(x.accepted, x.total, x.surplus) for x in got] == [(True, 1950, 0), (False, 1950, 0), (True, 1951, 0), (True, 500, 500), (False, 500, 500), (True, 2000, 500), (False, 2000, 500)]


def test_handshake_and_bodies(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", None)], "k string, v int")
    assert gates.handshake(rows, rows, ["k"], "v").where("k <> 'c'").count() == 0
    assert [tuple(r) for r in gates.handshake(rows.where("k < 'c'"), rows.where("k < 'c'").distinct(), ["k"], "v").collect()] == [("a", 1, 0)]
    landed = bodies(spark, video(viewCount="3"), video()).withColumn("views", F.lit(3).cast("long"))
    assert gates.unlike_body(landed, "body", raw.VIDEO_KIND, {"views": ("statistics.viewCount", "bigint")}).count() == 1


def test_set_digests_stream(spark):
    import hashlib

    rows = [("g", f"v{k % 700}") for k in range(2000)] + [("h", 'q"\\'), ("h", None), ("i", "é")]
    got = {r.k: r.digest for r in replay.set_digest(spark.createDataFrame(rows, "k string, v string").repartition(3), ["k"], "v").collect()}
    for key in "ghi":
        values = sorted({v for k, v in rows if k == key and v is not None})
        assert got[key] == hashlib.sha256(json.dumps(values, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_ledger(spark):
    charges = spark.createDataFrame([("r", 1, 1500, False), ("r", 2, 400, True), ("r", 3, 90, True), ("r", 4, 50, False)], "run_id string, seq int, units int, is_retry boolean")
    assert [x.accepted for x in raw.quota_ledger(charges).orderBy("seq").collect()] == [True, True, True, False]


def test_returned_ids(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "video_id string")
    got = {x.video_id: x.fault for x in raw.returned_ids(ids("a", "b", "c"), ids("b", "c", "c", "d")).collect()}
    assert got == {"a": "missing", "c": "duplicate", "d": "extra"}


def session(spark, *, drift=False, drop=False):
    digests = [("s", n, r, "x" if not drift or n == 1 else "y") for n in (1, 2) for r in ("r1", "r2")][: 3 if drop else 4]
    evidence = spark.createDataFrame(digests, "session_id string, round int, report_id string, digest string")
    sessions = spark.createDataFrame([("s", "sg8-pass-v1")], "session_id string, contract string")
    rounds = spark.createDataFrame([("s", n, "src", "h", "v", "0" * 64) for n in (1, 2)], "session_id string, round int, source_run_id string, snapshot_hash string, engine_version string, manifest_hash string")
    return {x.violation for x in replay.pass_gate(sessions, rounds, evidence).collect()}


def test_pass_gate(spark):
    assert session(spark) == set()
    assert session(spark, drift=True) == {"no_mismatch"}
    assert session(spark, drop=True) == {"evidence", "pairs", "no_mismatch"}


def test_row_digests_ignore_order_but_nothing_else(spark):
    rows = [("k", 1, "a"), ("k", 2, None), ("k", 2, "")]
    of = lambda r: {x.g: x.digest for x in replay.row_digests(spark.createDataFrame(r, "g string, n int, t string"), ["g"], ["n", "t"]).collect()}
    assert of(rows) == of(rows[::-1])
    assert of(rows) != of([*rows, rows[0]]) and of(rows) != of([rows[0], rows[1], rows[1]])


def test_reviews_need_an_entity(spark):
    waiting = spark.createDataFrame([("r", "v", "Name")], "run_id string, video_id string, candidate string")
    people = lambda a: spark.createDataFrame([("r", "v", True, a)], "run_id string, video_id string, approved boolean, artist_id string")
    assert replay.apply_review(waiting, people("a")).first().final_name == "Name"
    with pytest.raises(NotNullViolation, match="without an entity"), typed_errors():
        replay.apply_review(waiting, people(None)).collect()


def test_transitions(spark):
    changes = spark.createDataFrame([(None, "draft"), ("draft", "published"), ("published", "draft"), (None, "published"), ("archived", "archived")], "old string, new string")
    assert {(x.old, x.new) for x in gates.bad_transitions(changes, gates.REPORT_STATES).collect()} == {("published", "draft"), (None, "published"), ("archived", "archived")}
    steps = gates.session_transitions()
    assert (gates.SESSION_STATES[1], "failed") in steps and ("failed", gates.SESSION_STATES[0]) not in steps
    assert ("session_open", "r1_resolved") not in steps and ("r1_resolved", "r1_snapshot_frozen") in steps and ("r1_computed", "passed") in steps


def test_streams(spark, tmp_path):
    rows = [(datetime(2026, 6, 1, 10, m), 400) for m in (0, 5, 10, 20)] + [(datetime(2026, 6, 1, 15, 0), 10)]
    charges = spark.createDataFrame(rows, "ts timestamp, units int")
    batch = {(x.window.start, x.units) for x in quota.alerts(charges, slide="10 minutes").collect()}
    charges.repartition(1).write.parquet(f"{tmp_path}/c")
    stream = quota.alerts(spark.readStream.schema(charges.schema).parquet(f"{tmp_path}/c"), slide="10 minutes")
    q = stream.writeStream.format("memory").queryName("alerts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(x.window.start, x.units) for x in spark.table("alerts").collect()} == batch != set()
    intents = spark.createDataFrame([("p", "a", "r", "intent_to_produce_declared", datetime(2026, 6, 1, h)) for h in (1, 2)] + [("p", "b", "r", "report_opened", datetime(2026, 6, 1))], "producer_id string, artist_id string, report_id string, event_type string, created_at timestamp")
    intents.repartition(1).write.parquet(f"{tmp_path}/i")
    q = quota.first_intents(spark.readStream.schema(intents.schema).parquet(f"{tmp_path}/i")).writeStream.format("memory").queryName("intents").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("intents").count() == 1 == quota.first_intents(intents).count()
