import pytest
from test_report import END, GOLDEN, NAMES, VIDEO, plan

from gaugeline.errors import GateError
from gaugeline.plans.session import ReplaySession, SessionConflict, SessionError, folded


def opened(spark, tmp_path, videos):
    rows = [(run, *v[1:]) for run in ("ra", "rb") for v in videos]
    names = spark.createDataFrame(NAMES, "artist_id string, name string")
    channels = spark.createDataFrame([(c, None) for c in sorted({v[2] for v in rows})], "channel_id string, title string")
    runs = spark.createDataFrame([("ra", END), ("rb", END)], "run_id string, window_end timestamp")
    s = ReplaySession(spark, str(tmp_path), "s1", "src", {"report-a": "ra", "report-b": "rb"})
    s.freeze_input(plan.Relations(runs, spark.createDataFrame(rows, VIDEO), channels, names.withColumnRenamed("name", "canonical_name"), names))
    return s


AMBIGUOUS = [(*GOLDEN[0][:1], "amb", *GOLDEN[0][2:3], "Free Kairo Vee Type Beat", *GOLDEN[0][4:])]


def decisions(spark, *runs):
    return spark.createDataFrame([(r, "amb", True, "artist-kairo") for r in runs], "run_id string, video_id string, approved boolean, artist_id string")


def test_a_session_outlives_its_driver(spark, tmp_path):
    """After each step the object is dropped, and a fresh one goes on from the log."""
    again = lambda: ReplaySession.resume(spark, str(tmp_path), "s1")
    with pytest.raises(SessionError):
        again()
    opened(spark, tmp_path, GOLDEN[:20] + AMBIGUOUS)
    assert {r.video_id for r in again().resolve().collect()} == {"amb"}
    s = again()
    assert s.state == "r1_awaiting_review" and s.reports == {"report-a": "ra", "report-b": "rb"} and s.source_run_id == "src"
    with pytest.raises(GateError):
        s.review(decisions(spark, "ra"))
    again().review(decisions(spark, "ra", "rb"))
    assert again().state == "r1_resolved"
    again().freeze()
    assert again().state == "r1_snapshot_frozen"
    first = again().compute()
    s = again()
    assert s.state == "r1_computed" and {d[3] for d in s.digests} == set(first.values())
    with pytest.raises(SessionError):
        s.verdict()
    assert again().compute() == first
    with pytest.raises(SessionError, match="once"):
        again().compute()
    assert again().verdict("h") == [] and again().state == "passed"
    with pytest.raises(SessionError):
        again().compute()
    with pytest.raises(SessionError):
        again().freeze_input(None)


def test_two_drivers_cant_both_go_on(spark, tmp_path):
    opened(spark, tmp_path, GOLDEN[:3])
    a, b = (ReplaySession.resume(spark, str(tmp_path), "s1") for _ in range(2))
    assert a.state == b.state == "session_open"
    a.resolve()
    with pytest.raises(SessionConflict):
        b.resolve()
    assert b.state == a.state == "r1_resolved" and len(b.entries()) == 3


def test_freezing_what_waits_fails(spark, tmp_path):
    s = opened(spark, tmp_path, AMBIGUOUS)
    s.resolve()
    assert s.state == "r1_awaiting_review"
    with pytest.raises(SessionError):
        s.freeze()
    assert s.state == "failed" and ReplaySession.resume(spark, str(tmp_path), "s1").state == "failed"
    with pytest.raises(SessionError):
        s.freeze()


def test_drift_fails_and_steps_have_an_order(spark, tmp_path):
    s = opened(spark, tmp_path, GOLDEN[:4])
    with pytest.raises(SessionError):
        s.verdict()
    s.resolve()
    s.freeze()
    s.compute()
    s.entries()[-1]["round1"]["report-a"] = "0" * 64
    s.compute()
    assert s.verdict("h") == ["no_mismatch"] and s.state == "failed"


def test_logs_fold_to_states(spark):
    steps = ["r1_resolved", "session_open", "session_open", "r1_awaiting_review", "passed", "r1_resolved", "failed", "session_open"]
    log = spark.createDataFrame([("s", k, x) for k, x in enumerate(steps)] + [("t", 0, "session_open"), ("u", 1, None)], "session_id string, seq int, state string").repartition(3)
    got = [(r.accepted, r.state_after) for r in folded(log).where("session_id = 's'").orderBy("seq").collect()]
    assert got == [(False, None), (True, "session_open"), (False, "session_open"), (True, "r1_awaiting_review"), (False, "r1_awaiting_review"), (True, "r1_resolved"), (True, "failed"), (False, "failed")]
    assert folded(log.limit(0)).count() == 0
