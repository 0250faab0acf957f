"""What makes a step grow with no more than its input: parses a row, shuffles, bytes written."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from gaugeline.operators import gates, locators
from gaugeline.sources import landed, raw

VIDEO = {"kind": raw.VIDEO_KIND, "id": "v", "snippet": {"channelId": "c", "title": "[a] b", "publishedAt": "2026-01-01T00:00:00Z"}, "statistics": {"viewCount": "7"}}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_body_is_made_and_parsed_once_for_all_columns(spark):
    made = F.to_json(F.struct(F.lit(raw.VIDEO_KIND).alias("kind"), F.col("id"), F.struct(F.col("n").cast("string").alias("viewCount")).alias("statistics")))
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 3), ("c", None, 0), ("d", None, None)], "id string, n long, taken long")
    paths = {"id": ("id", "string"), "taken": ("statistics.viewCount", "bigint")}
    unlike = gates.unlike_body(rows.withColumn("body", made), "body", raw.VIDEO_KIND, paths).select("id")
    assert sorted(r.id for r in unlike.collect()) == ["b", "c"]
    assert optimized(unlike).count("to_json") <= 1 and "get_json_object" not in optimized(unlike)
    odd = [("x", 7, json.dumps(VIDEO | {"id": "x"})), ("y", 7, "no json"), ("z", None, None), ("w", 7, json.dumps(VIDEO | {"id": "w", "kind": "other"}))]
    bad = gates.unlike_body(spark.createDataFrame(odd, "id string, taken long, body string"), "body", raw.VIDEO_KIND, paths)
    assert sorted(r.id for r in bad.collect()) == ["w", "y", "z"]


def test_a_handshake_is_one_shuffle_of_as_many_tasks_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(gates, "TASK_ROWS", 10)
    left = spark.createDataFrame([(k, k % 3) for k in range(100)] + [(1, 1), (None, 1), (5, None)], "k long, v long")
    right = left.where("k IS NULL OR k <> 7").unionByName(spark.createDataFrame([(8, 9)], "k long, v long"))
    got = gates.handshake(left, right, ["k"], "v")
    assert {tuple(r) for r in got.collect()} == {(None, 1, 1), (5, 1, 1), (7, 1, 0), (8, 0, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(k" in plan and ", 21)" in plan


def test_a_body_is_parsed_few_times_for_its_projection(spark):
    bodies = spark.createDataFrame([(json.dumps(VIDEO),)], "body string")
    rows = raw.project_videos(bodies)
    assert tuple(rows.select("video_id", "source_title", "views").first()) == ("v", "[a] b", 7)
    told = optimized(rows)
    assert told.count("parseJson") + told.count("parse_json") == 2 and "json_object_keys" not in told and "get_json_object" not in told


def test_landed_bodies_take_less_room_than_their_text(spark, tmp_path):
    body = json.dumps(VIDEO)
    landed.land(spark.createDataFrame([("r", 1, body)] * 2000, "run_id string, page int, body string"), f"{tmp_path}/l")
    files = [p for p in Path(f"{tmp_path}/l").rglob("part-*") if not p.name.endswith(".crc")]
    assert sum(p.stat().st_size for p in files) < len(body) * 2000 / 5
    assert {r.body for r in landed.read_landed(spark, f"{tmp_path}/l").collect()} == {body}


def test_values_of_foreign_keys_are_json_without_a_parse_a_row(spark):
    texts = ["a", 'q"', "b\\", "\x01\n", "é,", "", '","']
    rows = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)] + [(None, "a", "a")], "n long, t string, u string")
    got = rows.select(gates.listed(rows, ("t", "n", "u")).alias("x"), F.to_json(F.array("t", F.col("n").cast("string"), "u")).alias("y"), gates.listed(rows, ("n",)).alias("z"), "n").where("n IS NOT NULL").collect()
    assert [r.x for r in got] == [r.y for r in got] and [r.z for r in got] == [f'["{r.n}"]' for r in got]
    none = rows.where("n < 0")
    tables = {"c": rows, "p": none}
    keys = [gates.ForeignKey("n", "c", ("n",), "p", ("n",)), gates.ForeignKey("t", "c", ("t", "u"), "p", ("t", "u"))]
    found = gates.foreign_keys(tables, keys)
    assert {(r.foreign_key, r.orphan, r.n) for r in found.collect()} >= {("n", '["0"]', 1), ("t", '["a","a"]', 2), ("t", json.dumps(['q"', 'q"'], separators=(",", ":")), 1)}
    assert "array_compact" not in optimized(found) and "filter(array" not in optimized(found)


def test_runs_of_locators_are_worked_out_once(spark):
    texts = spark.createDataFrame([(1, "see a/b.md:12 and é.py:3, _x.py:4\nnone"), (2, None), (3, ""), (4, "-./a.b.py/c.md.x.ts:7 …d.js:8")], "id int, text string")
    found = locators.findings(texts)
    assert sorted((r.id, r.cited_path, r.snippet) for r in found.collect()) == [(1, "_x.py", ":4"), (1, "a/b.md", ":12"), (1, "a/b.md", ":3"), (4, "a.b.py/c.md.x.ts", ":7"), (4, "d.js", ":8")]
    assert "size(transform" not in optimized(found) and "size(split" not in optimized(found)
