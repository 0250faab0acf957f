"""The digest tier reproduces the golden report byte for byte, whatever the order of the input."""

from datetime import UTC, datetime
from decimal import Decimal, localcontext

import pytest
from test_report import NAMES, VIDEO, plan, some

from gaugeline.operators import exact
from gaugeline.plans.config import Rubric

END = datetime(2026, 6, 30, tzinfo=UTC)
VIDEOS = [v[:1] + v[1:] for v in [*some("k", "Kairo Vee", 18, 15, 40000, 5000, 900, 29), *some("n", "Nova Blade", 18, 15, 40000, 5000, 900, 29), *some("r", "Rune Sol", 16, 12, 36000, 4200, 760, 29)]]
VIDEOS += [("run", "g0", "g-ch-0", "Ghost Lane Type Beat", 300, 10, 2, datetime(2026, 6, 12))]


def digest(spark, videos):
    rows = [("run-golden", *v[1:]) for v in videos]
    names = spark.createDataFrame(NAMES, "artist_id string, name string")
    channels = spark.createDataFrame([(c, None) for c in sorted({v[2] for v in rows})], "channel_id string, title string")
    runs = spark.createDataFrame([("run-golden", datetime(2026, 6, 30))], "run_id string, window_end timestamp")
    artists = names.withColumnRenamed("name", "canonical_name")
    stages = plan.stages(plan.Relations(runs, spark.createDataFrame(rows, VIDEO), channels, artists, names))
    per_artist = exact.artists(stages.eligible, runs)
    report = exact.canonical_report("run-golden", END, per_artist, exact.scores(per_artist), artists)
    return exact.report_digest(report), report, stages


@pytest.mark.parametrize("turn", [lambda x: x, lambda x: x[::-1]])
def test_golden_digest(spark, turn):
    got, report, stages = digest(spark, turn(VIDEOS))
    assert [r["score_value"] for r in report["rows"]] == [99, 99, 92]
    assert got == "c8e33fe85034e2c406bb189249ff829d8928a5b085d192c73220afcb89674ca8"


def test_a_changed_number_changes_the_digest(spark):
    changed = [(*v[:4], v[4] + (v[1] == "k00"), *v[5:]) for v in VIDEOS]
    assert digest(spark, changed)[0] != digest(spark, VIDEOS)[0]


def test_primitives():
    d = [Decimal(x) for x in (1, 2, 3, 4)]
    with localcontext(exact.frame(Rubric())):
        assert exact.middle(d) == Decimal("2.5") and exact.middle(d[:3]) == 2
        assert exact.at_share(d, Decimal("0.9")) == Decimal("3.7") and exact.at_share(d[:1], Decimal("0.9")) == 1
    assert exact.shown_velocity(Decimal("999.6"), Rubric()) == "1000/day" and exact.shown_velocity(Decimal(1250), Rubric()) == "1.3k/day"
