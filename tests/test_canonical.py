"""Canonical reports of many runs in one pass, evidence in chunks, foreign keys together."""

import hashlib
import json
from datetime import UTC

import pytest
from pyspark.sql import functions as F
from test_exact import VIDEOS
from test_report import END, GOLDEN, NAMES, plan, relations

from gaugeline.errors import ForeignKeyViolation
from gaugeline.operators import exact, gates
from gaugeline.operators import scoring as SC
from gaugeline.plans.config import canonical_json


def many_runs(spark):
    """The golden run, one that shows nothing, one without videos, and one with other names."""
    few = [("few", *v[1:]) for v in GOLDEN if v[1].startswith("gl")]
    other = [("öther\n", *v[1:]) for v in GOLDEN if v[1].startswith(("kv", "nb"))]
    golden = [("run-golden", *v[1:]) for v in VIDEOS]
    runs = spark.createDataFrame([(r, END) for r in ("run-golden", "few", "none", "öther\n")], "run_id string, window_end timestamp")
    r = relations(spark, [*golden, *few, *other])
    return plan.Relations(runs, r.videos, r.channels, r.artists, r.names)


def test_all_reports_are_each_report(spark):
    r = many_runs(spark)
    s = plan.stages(r)
    per_artist = exact.artists(s.eligible, r.runs)
    scored = exact.scores(per_artist)
    got = {x.run_id: (x.n, x.bytes, x.digest) for x in exact.canonical_reports(r.runs, per_artist, scored, r.artists).collect()}
    assert set(got) == {"run-golden", "few", "none", "öther\n"}
    assert got["run-golden"][2] == "c8e33fe85034e2c406bb189249ff829d8928a5b085d192c73220afcb89674ca8"
    for run_id, told in got.items():
        one = exact.canonical_report(run_id, END.replace(tzinfo=UTC), per_artist, scored, r.artists)
        assert told == (len(one["rows"]), len(canonical_json(one).encode()), exact.report_digest(one))
    assert got["none"][0] == got["few"][0] == 0 and got["none"] != got["few"]
    text = exact.canonical_reports(r.runs, per_artist, scored, r.artists)._jdf.queryExecution().toString()
    assert "collect_list" not in text.split("Physical Plan")[1].split("FlatMapGroupsInPandas")[0]


def test_canonical_lists(spark):
    rows = spark.createDataFrame([("a", k, None if k % 3 else "é \x1f\"", 1.5 * k) for k in range(700)] + [("b", 1, "", 0.0)], "g string, z int, m string, d double").withColumn("n", F.lit("12345678901234567890123456789.5").cast("decimal(38,1)"))
    got = {r.g: (r["n"], r["bytes"], r.digest) for r in exact.canonical_digests(rows.repartition(4), ["g"], ["z"]).collect()}
    for g in "ab":
        whole = json.dumps([{"g": x.g, "z": x.z, "m": x.m, "d": x.d, "n": str(x.n)} for x in rows.where(F.col("g") == g).orderBy("z").collect()], sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
        assert got[g] == (700 if g == "a" else 1, len(whole), hashlib.sha256(whole).hexdigest())


def test_evidence_streams_into_chunks(spark):
    rows = [("r", "a", f"v{k:04d}", None if k % 5 == 0 else k % 3, k, None) for k in range(1050)] + [("r", "b", "x", 7, 1, 1)]
    videos = spark.createDataFrame(rows, "run_id string, artist_id string, video_id string, views long, likes long, comments long").repartition(5)
    got = SC.evidence(videos, 100).orderBy("artist_id", "chunk").collect()
    assert [(r.artist_id, r.chunk, r.n) for r in got] == [*(("a", k, 100) for k in range(10)), ("a", 10, 50), ("b", 0, 1)]
    chain = ""
    for r in got[:-1]:
        body = json.loads(r.body)
        assert len(body) == r.n and body[0]["video_id"] == r.first_id and body[-1]["video_id"] == r.last_id
        assert all(v["rejected"] == ("views_null" if v["views"] is None else "views_null_or_zero" if v["views"] == 0 else None) for v in body)
        chain = hashlib.sha256((chain + r.body).encode()).hexdigest()
        assert r.chain == chain
    assert [v["video_id"] for r in got[:-1] for v in json.loads(r.body)] == sorted(r[2] for r in rows if r[1] == "a")
    assert "collect_list" not in SC.evidence(videos)._jdf.queryExecution().toString()


def test_all_foreign_keys_in_one_pass(spark):
    tables = {
        "child": spark.createDataFrame([(1, "x", "p"), (1, "y", "q"), (None, "x", "p"), (2, "x", None), (2, "x,y", "p"), (2, "x,y", "p")], "a int, b string, c string"),
        "pair": spark.createDataFrame([(1, "x"), (2, "x"), (2, "x,"), (2, "x")], "a int, b string"),
        "one": spark.createDataFrame([("p",)], "c string"),
    }
    keys = [gates.ForeignKey("child_pair", "child", ("a", "b"), "pair", ("a", "b")), gates.ForeignKey("child_one", "child", ("c",), "one", ("c",))]
    got = sorted(map(tuple, gates.foreign_keys(tables, keys).collect()))
    assert got == [("child_one", '["q"]', 1), ("child_pair", '["1","y"]', 1), ("child_pair", '["2","x,y"]', 2)]
    with pytest.raises(ForeignKeyViolation):
        gates.assert_foreign_keys(tables, keys)
    gates.assert_foreign_keys(tables | {"child": tables["child"].limit(1)}, keys)


def test_stages_drop_what_they_wrote(spark):
    import pathlib

    s = plan.stages(relations(spark, GOLDEN))
    s.scores.collect()
    files = [pathlib.Path(f.removeprefix("file:").replace("//", "/")) for df in (s.judged, s.resolved, s.verdicts, s.scores) for f in df.inputFiles()]
    assert files and all(f.exists() for f in files)
    s.drop()
    assert not any(f.exists() for f in files)
    assert NAMES


def test_figures_and_streamed_evidence_are_the_artists(spark):
    """Equal velocities told by id, ones that doubles take for equal, views of null and 0, and more candidates than a part has."""
    r = many_runs(spark)
    big = 2**53
    twins = [("run-golden", f"kw{k}", f"kc{k}", "Kairo Vee Type Beat", v, 3, None, END.replace(day=2)) for k, v in enumerate((big + 1, big, big + 2, None, 0, None, 0, 7))]
    r = plan.Relations(r.runs, r.videos.unionByName(relations(spark, twins).videos.select(r.videos.columns)), relations(spark, [*GOLDEN, *VIDEOS, *twins]).channels, r.artists, r.names)
    s = plan.stages(r)
    videos = exact.timed(s.eligible, r.runs)
    whole = exact.artists(s.eligible, r.runs)
    same = [c for c in whole.columns if c not in ("reason", "example")]
    assert sorted(map(tuple, exact.figures(videos).collect())) == sorted(map(tuple, whole.select(same).collect()))
    parts = {}
    for p in exact.evidence(videos, size=4).orderBy("run_id", "artist_id", "part").collect():
        parts.setdefault((p.run_id, p.artist_id), []).append(p)
    for a in whole.collect():
        head, *bodies, tail = parts[a.run_id, a.artist_id]
        assert head[3:5] == tail[3:5] and head.example == a.example
        assert {"candidates": json.loads(f"[{''.join(b.body for b in bodies)}]"), **json.loads(head.said)} == json.loads(a.reason)
    scored = exact.scores(whole)
    streamed = exact.canonical_reports(r.runs, exact.figures(videos), scored, r.artists, videos=videos)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, exact.canonical_reports(r.runs, whole, scored, r.artists).collect()))
    assert "FlatMapGroupsInPandas" not in exact.figures(videos)._jdf.queryExecution().toString()
