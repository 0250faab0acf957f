"""The report plan on small fixtures: golden scores, order of input, gates and boundaries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import channels as C
from gaugeline.operators import report as R
from gaugeline.operators import resolution as N
from gaugeline.operators import scoring as SC
from gaugeline.operators.gates import GateError
from gaugeline.plans import report as plan

END = datetime(2026, 6, 30)
VIDEO = "run_id string, video_id string, channel_id string, source_title string, views long, likes long, comments long, published_at timestamp"


def some(prefix, name, n, channels, base, likes, comments, day):
    return [("run", f"{prefix}{i:02d}", f"{prefix}-ch-{i % channels:02d}", f"{name} Type Beat", base + 10 * i, likes, comments, datetime(2026, 6, day)) for i in range(n)]


GOLDEN = [*some("kv", "Kairo Vee", 18, 15, 40000, 5000, 900, 29), *some("nb", "Nova Blade", 18, 15, 40000, 5000, 900, 29), *some("rs", "Rune Sol", 16, 12, 36000, 4200, 760, 29), *some("gl", "Ghost Lane", 1, 1, 300, 10, 2, 12)]
NAMES = [("artist-kairo", "Kairo Vee"), ("artist-nova", "Nova Blade"), ("artist-rune", "Rune Sol"), ("artist-ghost", "Ghost Lane")]


def relations(spark, videos, names=NAMES, titles=None):
    v = spark.createDataFrame(videos, VIDEO)
    channels = spark.createDataFrame([(c, (titles or {}).get(c)) for c in sorted({x[2] for x in videos})] or [], "channel_id string, title string")
    return plan.Relations(
        spark.createDataFrame([("run", END)], "run_id string, window_end timestamp"), v, channels, spark.createDataFrame(names, "artist_id string, canonical_name string"), spark.createDataFrame(names, "artist_id string, name string")
    )


@pytest.mark.parametrize("turn", [lambda x: x, lambda x: x[::-1], lambda x: x[7:] + x[:7]])
def test_golden_scores(spark, turn):
    r = relations(spark, turn(GOLDEN))
    s = plan.stages(r)
    assert {x.artist_id: x.final_score for x in s.scores.collect()} == {"artist-kairo": 99, "artist-nova": 99, "artist-rune": 92, "artist-ghost": 15}
    rows = plan.report(r).orderBy("rank").collect()
    assert [(x.rank, x.artist_id, x.tag) for x in rows] == [(1, "artist-kairo", "HOT"), (2, "artist-nova", "HOT"), (3, "artist-rune", None)]
    assert rows[0].score_display == "99/100" and rows[0].competition_level == "Medium" and rows[0].signals == 18


def test_empty_and_insufficient(spark):
    empty = relations(spark, [])
    assert plan.report(empty).count() == 0
    few = relations(spark, [*some("gl", "Ghost Lane", 1, 1, 300, 10, 2, 12), *some("rs", "Rune Sol", 1, 1, 400, 10, 2, 12)])
    assert plan.report(few).count() == 0
    assert [(x.n_scored, x.n_qualified, x.insufficient) for x in R.run_status(few.runs, plan.stages(few).scores).collect()] == [(2, 0, True)]


def test_domination_and_self_channels(spark):
    def on(channel, name, n):
        return [("run", f"{channel}-{i:03d}", channel, f"{name} Type Beat", 100, 1, 1, datetime(2026, 6, 20)) for i in range(n)]

    videos = [*on("c60", "Kairo Vee", 60), *on("c61", "Nova Blade", 61), *on("own", "Rune Sol", 2), *on("own", "Ghost Lane", 0)]
    r = relations(spark, videos, titles={"own": "RUNE—sol"})
    got = {x.channel_id: (x.reason_code, x.is_eligible, x.run_videos) for x in plan.stages(r).verdicts.collect()}
    assert got == {"c60": ("eligible", True, 60), "c61": ("run_domination", False, 61), "own": ("self_channel", False, 2)}
    people = spark.createDataFrame([("c61", True), ("c60", False)], "channel_id string, is_eligible boolean")
    got = {x.channel_id: (x.reason_code, x.is_eligible) for x in plan.stages(r, overrides=people).verdicts.collect()}
    assert got["c61"] == ("human_override", True) and got["c60"] == ("human_override", False)
    assert C.missing_records(plan.stages(r).mapped, r.channels.where("channel_id <> 'own'")).collect()[0].channel_id == "own"


def test_resolution_order(spark):
    videos = [("run", f"v{i}", "c", t, 1, 1, 1, END) for i, t in enumerate(["Kairo Vee Type Beat", " ", "A x B Type Beat", "nothing here", "Nobody Known Type Beat", "Kairo Vee Type Beat"])]
    names = spark.createDataFrame([("a1", "Kairo Vee"), ("a2", "Twin"), ("a3", "twin")], "artist_id string, name string")
    v = spark.createDataFrame(videos, VIDEO)
    facts = spark.createDataFrame([("run", "v3", "human", "X", "accepted", "X", "review_approved", "a9"), ("run", "v1", "human", "X", "accepted", "X", "review_approved", "a9")], "run_id string, video_id string, method string, candidate string, decision string, final_name string, reason_code string, artist_id string")
    pending = spark.createDataFrame([("run", "v5", "Kairo", "llm", "old"), ("run", "v3", "Z", "llm", "old")], "run_id string, video_id string, proposed_name string, method string, resolver_version string")
    got = {x.video_id: (x.decision, x.reason_code, x.artist_id, x.needs_review, x.replayed) for x in N.resolve(v, names, facts=facts, pending=pending).collect()}
    assert got["v0"] == ("accepted", "regex_autoaccepted", "a1", False, False)
    assert got["v1"] == ("rejected", "source_title_missing", None, False, False)
    assert got["v2"] == ("review_required", "llm_unavailable", None, True, False)
    assert got["v3"] == ("accepted", "review_approved", "a9", False, True)
    assert got["v4"] == ("accepted", "regex_autoaccepted", None, False, False)
    assert got["v5"] == ("review_required", "pending_resolver_version_conflict", None, True, True)
    assert {x.video_id for x in N.final_mappings(N.resolve(v, names)).collect()} == {"v0", "v5"}


def test_examples(spark):
    day = timedelta(days=1)
    rows = [("r", "a", "v1", 5.0, END - day, 10), ("r", "a", "v2", 9.0, END - 2 * day, 99), ("r", "a", "v3", 7.0, END - day, None), ("r", "a", "v4", 1.0, END, 500), ("r", "b", "v5", None, END, None), ("r", "c", "x2", 1.0, END, 3), ("r", "c", "x1", 1.0, END, 3)]
    frame = spark.createDataFrame(rows, "run_id string, artist_id string, video_id string, vel double, published_at timestamp, views long")
    got = {x.artist_id: (x.example_video_id, x.rule_applied) for x in R.examples(frame).collect()}
    assert got == {"a": ("v1", "secondary"), "b": ("v5", "primary"), "c": ("x1", "final")}


def test_growth_windows_share_no_instant(spark):
    at = lambda d, s=0: ("r", "a", END - timedelta(days=d, seconds=s), END)
    frame = spark.createDataFrame([at(0), at(7), at(6, 86399), at(14), at(13, 86399)], "run_id string, artist_id string, published_at timestamp, window_end timestamp")
    got = R.publication_counts(frame).first()
    assert (got.recent_7d, got.prior_7d) == (2, 2)


def test_hot_needs_more_than_90(spark):
    scores = spark.createDataFrame([("r", f"a{i}", s, 0.5, 0.5) for i, s in enumerate([90, 91, 95, 99, 83, 82])], "run_id string, artist_id string, final_score int, norm_velocity double, norm_signals double")
    got = [(x.artist_id, x.tag) for x in R.shown(scores).orderBy("rank").collect()]
    assert got == [("a3", "HOT"), ("a2", "HOT"), ("a1", None), ("a0", None), ("a4", None)]
    many = spark.createDataFrame([("r", f"a{i:02d}", 88, 0.5, 0.5) for i in range(14)], "run_id string, artist_id string, final_score int, norm_velocity double, norm_signals double")
    assert R.shown(many).count() == 10


def test_plan_has_no_python_and_prunes(spark):
    from gaugeline.plans import queries as q

    s = q.stages_of(spark, "/root/testdata/sf0.001")
    outcomes, rows = s.outcomes._jdf.queryExecution().toString(), q.report_rows(spark, "/root/testdata/sf0.001")
    text = rows._jdf.queryExecution().toString()
    for t in (outcomes, text):
        assert "Python" not in t and "Cartesian" not in t and "l_tax" not in t.split("== Physical Plan ==")[1]
    # Outcomes read the videos once and match no pattern; the report reads neither.
    physical = outcomes.split("== Physical Plan ==")[1]
    assert physical.count("lineitem.parquet") <= 1 and "RLIKE" not in physical
    rows.collect()
    executed = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "lineitem" not in executed and "RLIKE" not in executed and "regexp" not in executed
    assert 0 < executed.count(" Exchange hash") <= 5 and executed.count("Scan parquet") <= 5
    spark.catalog.clearCache()


def test_videos_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def told(title):
        made.add(1)
        return title

    r = relations(spark, GOLDEN)
    counting = r.videos.withColumn("source_title", F.udf(told, "string")("source_title"))
    assert plan.report(plan.Relations(r.runs, counting, r.channels, r.artists, r.names)).count() == 3
    assert made.value == len(GOLDEN)


def test_verdicts_make_no_list_of_artists(spark):
    rows = [(*x[:2], "own", *x[3:]) for x in GOLDEN[:4]] + [(*x[:2], "own", *x[3:]) for x in GOLDEN[20:22]] + GOLDEN[40:]
    s = plan.stages(relations(spark, rows, titles={"own": "nova-blade", "rs-ch-01": "Kairo Vee"}))
    got = C.verdicts(s.mapped, s.relations.channels, s.relations.names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, s.verdicts.collect()))
    assert {(x.channel_id, x.run_videos) for x in got.where("reason_code = 'self_channel'").collect()} == {("own", 6)}
    assert "collect_" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_only_videos_that_can_be_examples_are_sorted(spark):
    def rows(artist, n, channels, views):
        return [("run", f"{artist}{i:03d}", f"{artist}-{i % channels}", f"{artist} Type Beat", views(i), 9, 9, datetime(2026, 6, 1 + i % 29)) for i in range(n)]

    names = [(f"artist-{a}", a) for a in ("Ann", "Bob", "Cyd", "Dee")]
    videos = [*rows("Ann", 200, 40, lambda i: 40000 + i * 7919 % 400), *rows("Bob", 60, 2, lambda i: 50000), *rows("Cyd", 90, 30, lambda i: None if i % 7 else 40000 + i), *rows("Dee", 50, 9, lambda i: None)]
    s = plan.stages(relations(spark, videos, names))
    by_artist = {}
    for x in s.measured.collect():
        by_artist.setdefault(x.artist_id, []).append(-1.0 if x.vel is None else x.vel)
    for x in s.scores.collect():
        third = sorted(by_artist[x.artist_id])[-3]
        assert x.fast_from is None or x.fast_from <= third
        assert x.fast_from is not None or x.artist_id in ("artist-Bob", "artist-Dee")
        if x.artist_id == "artist-Ann":
            assert sum(v >= x.fast_from for v in by_artist[x.artist_id]) < 40
    whole = {(x.artist_id, x.example_video_id, x.rule_applied) for x in R.examples(s.measured).collect()}
    shown = {(x.artist_id, x.example_video_id, x.rule_applied) for x in plan.report(s.relations).collect()}
    assert len(shown) > 1 and shown <= whole


def test_keys_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7))
    plan.check(relations(spark, GOLDEN))
    with pytest.raises(GateError, match="one row a video"):
        plan.check(relations(spark, [*GOLDEN, GOLDEN[0]]))


def test_only_eligible_videos_raise_for_the_future(spark):
    late = ("run", "late", "own", "Rune Sol Type Beat", 5, 1, 1, END + timedelta(days=1))
    assert {x.artist_id for x in plan.stages(relations(spark, [*GOLDEN, late], titles={"own": "Rune Sol"})).scores.collect()} == {a for a, _ in NAMES}
    with pytest.raises(Exception, match="after the window"):
        plan.stages(relations(spark, [*GOLDEN, late])).scores.collect()


def test_gates_fail_closed(spark):
    r = relations(spark, [GOLDEN[0], GOLDEN[0]])
    with pytest.raises(GateError, match="one row a video"):
        plan.check(r)
    plan.check(relations(spark, GOLDEN))
    for broken in ([GOLDEN[0], GOLDEN[0]], [(*GOLDEN[0][:2], " ", *GOLDEN[0][3:])], [(*GOLDEN[0][:7], None)]):
        with pytest.raises(GateError, match="one row a video"):
            plan.report(relations(spark, broken))
    whole = relations(spark, GOLDEN)
    without = plan.Relations(whole.runs, whole.videos, whole.channels.where("channel_id <> 'kv-ch-00'"), whole.artists, whole.names)
    with pytest.raises(GateError, match="every channel has a record"):
        plan.report(without)
    assert SC.scored(SC.artist_metrics(plan.stages(relations(spark, GOLDEN)).measured)).where(F.col("v_ref").isNull()).count() == 0
