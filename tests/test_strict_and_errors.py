"""Strict JSON, and refusals by class."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeline import errors as E
from gaugeline.functions.strict import is_json
from gaugeline.operators import gates
from gaugeline.operators import resolution as N
from gaugeline.sources import raw

REFUSED = ['{"candidate":"x"} trailing', '{"candidate":"x"}{"a":1}', "{'candidate':'x'}", "", " ", '{"candidate":"x"', '{"candidate":"x"},{"candidate":"y"}', '{"candidate":"x"}] [', '{"candidate":"x"}} {', '{"candidate":"x"},', '{"candidate":"x",}', '{candidate:"x"}', '{"candidate":"x"}]}', "nul", '{"candidate":"a\nb"}', '// c\n{"candidate":"x"}', "﻿{}"]
TAKEN = ['{"candidate":"x"}', ' \n\t{"candidate" : "x\\u00e9\\n"}\r\n', "null", "1", '"]"', "[]", '{"a":{"b":["}]"]}}']


def test_strict_json(spark):
    for texts, wanted in ((REFUSED, False), (TAKEN, True)):
        for t in texts:
            if t != '{"candidate":"x"} trailing':
                assert _python(t) is wanted, t
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_json(F.col("t")).alias("good")).collect()
        assert [r.t for r in rows if r.good is not wanted] == []
    assert spark.createDataFrame([(None,)], "t string").select(is_json(F.col("t")).alias("x")).first().x is False


def _python(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_replies_are_one_strict_object(spark):
    good = {'{"candidate":"x"}': "x", ' {"candidate": null} ': None, '{"candidate":"q\\"é\\u0041"}': 'q"éA', '{"candidate":""}': "", '{"candidate":"n"}': "n"}
    bad = [*REFUSED, "[]", '{"candidate":5}', '{"candidate":["x"]}', '{"candidate":"x","y":1}', '{"y":"x"}', "{}", None, '{"candidate":"a","candidate":"b"}', '{"candidate":true}']
    candidate, error = N.parse_reply(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", candidate.alias("c"), error.alias("e")).collect()
    for r in rows:
        assert (r.c, r.e) == ((good[r.t], None) if r.t in good else (None, "llm_contract_violation")), r


VIDEO = {"kind": "youtube#video", "id": "v", "snippet": {"channelId": "c", "title": "t", "publishedAt": "2026-06-01T00:00:00Z"}, "statistics": {"viewCount": "3"}}


@pytest.mark.parametrize(
    ("body", "error"),
    [
        (json.dumps(VIDEO) + " junk", E.MalformedBody), (json.dumps(VIDEO) + "{}", E.MalformedBody), (str(VIDEO), E.MalformedBody), (json.dumps({**VIDEO, "kind": "video"}), E.WrongKind), (json.dumps({**VIDEO, "headers": {}}), E.TransportKeys),
        (json.dumps({**VIDEO, "id": 5}), E.TextExpected), (json.dumps({**VIDEO, "id": None}), E.FieldMissing), (json.dumps({**VIDEO, "statistics": {"viewCount": "many"}}), E.CountExpected), (json.dumps({**VIDEO, "statistics": {"viewCount": "1.5"}}), E.CountExpected),
    ],
)
def test_bodies_are_refused_by_class(spark, body, error):
    rows = raw.project_videos(spark.createDataFrame([(json.dumps(VIDEO),), (body,)], "body string"))
    with pytest.raises(error) as raised, E.typed_errors():
        rows.collect()
    assert isinstance(raised.value, E.BodyError) and raised.value.message


def test_gates_raise_their_class(spark):
    rows = spark.createDataFrame([("a", None)], "k string, v string")
    for error in (E.NotNullViolation, E.UniqueViolation, E.ForeignKeyViolation, E.CheckViolation, E.IntegrityViolation):
        with pytest.raises(error) as raised:
            gates.assert_empty(rows, "the gate", error)
        assert isinstance(raised.value, E.GateError) and raised.value.message == "the gate" and "'k': 'a'" in raised.value.parameters["rows"][0]
    gates.assert_empty(rows.limit(0), "the gate")


def test_errors_keep_their_parameters(spark):
    odd = 'q"\\ é\n]'
    rows = spark.createDataFrame([(odd,)], "t string").select(E.refuse(E.OutsideTitle, "not there", title=F.col("t")))
    with pytest.raises(E.OutsideTitle) as raised, E.typed_errors():
        rows.collect()
    assert raised.value.parameters == {"title": odd} and raised.value.message == "not there"
    other = ValueError("nothing of ours")
    assert E.typed(other) is other and E.typed(raised.value) is raised.value
    assert set(E.classes()) >= {"RunExists", "SessionConflict", "RepeatedToken"}


def test_unjudged_titles_and_null_titles(spark):
    """Null titles look nothing up, wherever they are; a title that wasn't judged raises."""
    videos = spark.createDataFrame([("r", f"v{k}", None if k % 2 else "a") for k in range(200)], "run_id string, video_id string, source_title string")
    judged = spark.createDataFrame([("a", "x", "regex_autoaccepted", "1"), (None, None, "source_title_missing", None)], "source_title string, rule_candidate string, rule_reason string, rule_artist_id string")
    got = N.attempts(videos, judged)
    assert got.columns == [*videos.columns, "rule_candidate", "rule_reason", "rule_artist_id"]
    assert got.groupBy("rule_reason").count().orderBy("rule_reason").collect() == [("regex_autoaccepted", 100), ("source_title_missing", 100)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        where = [r.p for r in N.attempts(videos.repartition(2), judged).withColumn("p", F.spark_partition_id()).collect() if r.source_title is None]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(where) == 100 and max(map(where.count, where)) < 60
    with pytest.raises(E.OutsideTitle), E.typed_errors():
        N.attempts(videos, judged.where("source_title IS NULL")).collect()
