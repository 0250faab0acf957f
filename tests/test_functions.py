"""Scalar functions at their edges: half-up rounding, nulls that aren't zeros, Unicode titles."""

import math
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeline.errors import FutureVideo, typed_errors
from gaugeline.functions import scoring as S
from gaugeline.functions import text as X
from gaugeline.plans.config import ConfigError, FilterRule, ReportRules, Rubric, manifest_hash


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def test_identities():
    assert Rubric().hash == "f0c465fbf790d1ca445e62ca13b58312bdb31c1b99a3caaf7b0be3eef083ca54"
    assert FilterRule().hash == "7a1e3c76c4bd6b666939f0b1c84e257ea77e9d05c26dcfd2164e2f74cedeaea7"
    assert ReportRules().hash == "ce7c7c1ad5d400ff6dcf9822e436db0def9cde75ffa555568acc0219b1fba52f"
    assert manifest_hash("a") != manifest_hash("b") and manifest_hash("a") != manifest_hash("a", rule=FilterRule(most_videos=61))


@pytest.mark.parametrize("make", [lambda: Rubric(velocity=Rubric().signals), lambda: Rubric(signals_cap=0), lambda: ReportRules(hot_above=80), lambda: ReportRules(low_channels=15)])
def test_contradictions_are_refused(make):
    with pytest.raises(ConfigError):
        make()


@pytest.mark.parametrize(("text", "want"), [("  KAIRO—Vée  ", "kairo vée"), ("Straße", "strasse"), ("ﬁne  ①", "fine 1"), (None, ""), ("a_b\tc", "a b c"), ("…", "")])
def test_normalize(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(X.normalize(F.col("t")).alias("x")).first().x == want == X.normalized_text(text)


@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126)))
def test_plain_titles_need_no_python(text):
    import re

    assert re.sub(r"[^a-z0-9]+", " ", text.lower()).strip() == X.normalized_text(text)


@pytest.mark.parametrize(
    ("title", "markers", "candidate"),
    [("FREE | Kairo Vee Type Beat", 1, "Kairo Vee"), ("a: b) - c type  beat", 1, "c"), ("x - - y Type Beat", 1, "- y"), ("no marker", 0, ""), ("Type Beat type beat", 2, ""), ("étype beat", 0, ""), ("(a [b] c Type Beat", 1, "c")],
)
def test_candidates(spark, title, markers, candidate):
    frame = spark.createDataFrame([(title,)], "t string")
    got = frame.select(X.marker_count(F.col("t")).alias("n"), X.candidate(F.col("t")).alias("c")).first()
    assert (got.n, got.c) == (markers, candidate)


@pytest.mark.parametrize(("text", "several", "metadata"), [("a x b", True, False), ("ax b", False, False), ("A feat. B", True, False), ("A & B", True, False), ("free a", False, True), ("a 2024", False, True), ("L5", False, False), ("c# min", False, True), ("140bpm", False, True), ("[a", False, True)])
def test_detectors(spark, text, several, metadata):
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(X.names_several(F.col("t")).alias("s"), X.has_metadata(F.col("t")).alias("m")).first()
    assert (got.s, got.m) == (several, metadata)


@pytest.mark.parametrize(("raw", "want"), [(90.5, 91), (82.5, 83), (82.49, 82), (0.0, 0), (100.0, 100)])
def test_scores_round_half_up(spark, raw, want):
    assert one(spark, S.final_score(F.lit(raw))) == want


@pytest.mark.parametrize(("value", "want"), [(None, None), (999.6, "1000/day"), (1000.0, "1.0k/day"), (1250.0, "1.3k/day"), (0.5, "1/day"), (12.4, "12/day")])
def test_velocity_display(spark, value, want):
    assert one(spark, S.velocity_display(F.lit(value).cast("double"))) == want


@pytest.mark.parametrize(("n", "want"), [(5, "Low"), (6, "Medium"), (15, "Medium"), (16, "High")])
def test_competition(spark, n, want):
    assert one(spark, S.base_competition(F.lit(n))) == want
    assert one(spark, S.competition(F.lit(n), F.lit(3), F.lit(2))) == want  # exactly 50 % doesn't trigger
    assert one(spark, S.competition(F.lit(n), F.lit(9), F.lit(0))) == want
    assert one(spark, S.competition(F.lit(n), F.lit(4), F.lit(2))) == "High"


def test_nulls_are_not_zeros(spark):
    null = F.lit(None).cast("long")
    assert one(spark, S.velocity(null, F.lit(2.0))) is None
    assert one(spark, S.velocity(F.lit(0), F.lit(2.0))) == 0
    assert one(spark, S.engagement_rate(F.lit(1), F.lit(1), F.lit(0))) is None
    assert one(spark, S.engagement_rate(null, F.lit(2), F.lit(4))) == 0.5
    assert one(spark, S.anchored(F.lit(None).cast("double"), F.lit(1.0))) == 0
    assert one(spark, S.anchored(F.lit(1.0), F.lit(0.0))) == 0
    assert one(spark, S.ln_saturating(F.lit(20), 20)) == 1 and one(spark, S.ln_saturating(F.lit(0), 20)) == 0
    assert one(spark, S.recency_weight(F.lit(15.0))) == pytest.approx(0.5)
    assert one(spark, S.ln_saturating(F.lit(3), 20)) == pytest.approx(math.log(4) / math.log(21))


def test_age(spark):
    at = lambda d: F.lit(datetime(2026, 6, d)).cast("timestamp")
    assert one(spark, S.age_days(at(1), at(3))) == 2 and one(spark, S.effective_age(S.age_days(at(3), at(3)))) == 1
    with pytest.raises(FutureVideo, match="after the window"), typed_errors():
        one(spark, S.age_days(at(4), at(3)))
