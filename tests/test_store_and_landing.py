"""Runs written once by many writers, and landed bodies as a data source."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gaugeline.errors import MalformedBody, NotNullViolation, RunExists, RunMissing, typed_errors
from gaugeline.sources import landed, raw
from gaugeline.sources.store import RunStore

ROW = "run_id string, n int"


def rows(spark, *runs, size=5):
    return spark.createDataFrame([(r, k) for r in runs for k in range(size)], ROW).repartition(2)


def seen(df):
    return {r.run_id: r["count"] for r in df.groupBy("run_id").count().collect()}


def test_runs_are_whole_and_once(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/s")
    assert store.manifest().count() == 0
    store.write(rows(spark, "2024", "a b/c"))
    with pytest.raises(RunExists) as raised:
        store.write(rows(spark, "new", "2024"))
    assert raised.value.parameters["runs"] == ["2024"]
    store.write(rows(spark, "new", size=3))
    assert seen(store.read()) == {"2024": 5, "a b/c": 5, "new": 3}
    assert sorted(store.read().columns) == ["n", "run_id"] and dict(store.read().dtypes)["run_id"] == "string"
    with pytest.raises(NotNullViolation):
        store.write(rows(spark, " "))
    with pytest.raises(RunMissing):
        store.read_run("none")


def test_a_scan_reads_one_partition(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/s")
    store.write(rows(spark, "r1", "r2", "r3"))
    one = store.read_run("r2")
    assert seen(one) == {"r2": 5}
    assert {f.split("run_id=")[1].split("/")[0] for f in one.inputFiles()} >= {"r2"}
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "run_id" in plan.split("PartitionFilters")[1][:120] and "attempt" in plan.split("PartitionFilters")[1][:200]


def test_readers_see_nothing_that_isnt_published(spark, tmp_path):
    """Rows that a writer staged before it died are there, and not seen; the run can be written once its claim is withdrawn."""
    store = RunStore(spark, f"{tmp_path}/s")
    store.write(rows(spark, "good"))
    store.claim(rows(spark, "half").select("run_id").distinct(), "dead")
    rows(spark, "half").write.partitionBy("run_id").parquet(f"{tmp_path}/s/rows/attempt=dead")
    assert seen(store.read()) == {"good": 5}
    with pytest.raises(RunExists):
        store.write(rows(spark, "half"))
    store.withdraw("dead")
    store.write(rows(spark, "half", size=2))
    assert seen(store.read()) == {"good": 5, "half": 2}


def test_of_writers_that_meet_at_most_one_goes_on(spark, tmp_path):
    def attempt(k):
        try:
            RunStore(spark, f"{tmp_path}/s").write(rows(spark, "hot", f"own{k}", size=4 + k))
        except RunExists:
            return None
        return k

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(attempt, range(4)) if k is not None]
    store = RunStore(spark, f"{tmp_path}/s")
    assert len(won) <= 1 and store.manifest().where("run_id = 'hot'").count() == len(won)
    assert seen(store.read()) == ({"hot": 4 + won[0], f"own{won[0]}": 4 + won[0]} if won else {}) if store.manifest().count() else True
    if not won:  # all saw each other and withdrew: the next one goes on
        store.write(rows(spark, "hot"))
        assert seen(store.read()) == {"hot": 5}


BODY = json.dumps({"kind": "youtube#video", "id": "v", "snippet": {"channelId": "c", "title": "té\nx", "publishedAt": "2026-06-01T00:00:00Z"}, "statistics": {}}, indent=1, ensure_ascii=False)


def test_bodies_come_back_verbatim(spark, tmp_path):
    bodies = [("r 1/x", 0, BODY), ("r 1/x", 1, " \r\n{}\n\n"), ("r2", 0, ""), ("r2", 7, "x" * 3_000_000), ("r2", 7, "é ")]
    landed.land(spark.createDataFrame(bodies, "run_id string, page int, body string"), f"{tmp_path}/l")
    got = landed.read_landed(spark, f"file://{tmp_path}/l")
    assert sorted(map(tuple, got.collect())) == sorted(bodies)
    projected = raw.project_videos(got.where("run_id = 'r 1/x' AND page = 0").select("run_id", "body")).collect()
    assert [(r.run_id, r.video_id, r.source_title) for r in projected] == [("r 1/x", "v", "té\nx")]
    for bad in (None, "a\x1eb"):
        with pytest.raises(MalformedBody), typed_errors():
            landed.land(spark.createDataFrame([("r", 0, bad)], "run_id string, page int, body string"), f"{tmp_path}/bad{bad}")


def test_filters_leave_folders_out(spark, tmp_path):
    landed.land(spark.createDataFrame([(f"r{k % 4}", k % 3, "{}") for k in range(24)], "run_id string, page int, body string").repartition(1), f"{tmp_path}/l")
    whole = landed.read_landed(spark, f"{tmp_path}/l")
    assert whole.rdd.getNumPartitions() == 12
    one = whole.where("run_id = 'r1' AND body <> 'x'")
    assert one.rdd.getNumPartitions() == 3 and one.count() == 6
    assert whole.where(F.col("run_id").isin("r1", "r2") & (F.col("page") == 2)).rdd.getNumPartitions() == 2
    assert whole.where("run_id = 'none'").count() == 0


def test_pieces_of_any_size_give_the_same_bodies():
    data = "\x1e{}\n\x1e\n\x1ea\nb\n\n\x1eé\n".encode()
    for size in (1, 2, 3, 100):
        assert list(landed.bodies_of(data[k : k + size] for k in range(0, len(data), size))) == ["{}", "", "a\nb\n", "é"]
    assert list(landed.bodies_of([])) == [] and list(landed.bodies_of([b"no record"])) == []
