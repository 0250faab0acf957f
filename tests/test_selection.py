"""Exact percentiles: selection by bits against Spark's own aggregate, and the plan that they run on."""

import numpy as np
from pyspark.sql import functions as F

from gaugeline.operators import scoring as SC
from gaugeline.operators import selection
from gaugeline.plans.config import Rubric

SHARES = {"m": 0.5, "p": 0.9, "z": 0.0, "o": 1.0, "q": 0.123}


def test_bits_keep_the_order():
    values = np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e308, np.inf])
    bits = selection.ordered_bits(values)
    assert (np.diff(bits) > 0).all() and (selection.from_bits(bits) == values).all()
    assert selection.ordered_bits(np.array([-0.0]))[0] == selection.ordered_bits(np.array([0.0]))[0]
    assert selection.ordered_bits(np.array([np.nan]))[0] > bits[-1]


def plain(rows):
    return sorted(map(tuple, rows.groupBy("k").agg(*(F.percentile("v", F.lit(x)).alias(n) for n, x in SHARES.items())).collect()), key=lambda r: r[0])


def test_selection_is_spark_percentile(spark):
    """Hot groups with ties, nulls, huge and negative values; small ones beside them, and one with nulls only."""
    rows = spark.range(60_000, numPartitions=3).selectExpr("id % 3 AS k", "CASE WHEN id % 17 = 0 THEN NULL WHEN id % 5 = 0 THEN 2.5D WHEN id % 7 = 0 THEN -1e300 * rand(3) ELSE randn(7) * pow(10, id % 40) END AS v").where("k <> 1 OR id < 4000")
    rows = rows.unionByName(spark.range(2).selectExpr("9L AS k", "CAST(NULL AS DOUBLE) AS v")).unionByName(spark.range(5000).selectExpr("7L AS k", "1.5D AS v"))
    got = sorted(map(tuple, selection.percentiles(rows, ["k"], "v", SHARES, hot_rows=3000).collect()), key=lambda r: r[0])
    assert got == plain(rows)
    assert sorted(map(tuple, selection.percentiles(rows, ["k"], "v", SHARES).collect()), key=lambda r: r[0]) == got


def test_order_statistics_keep_no_group(spark):
    """No step gathers a group: histograms are sums by digit, and there is no percentile or list in the plan."""
    rows = spark.range(1_000_000).selectExpr("0 AS k", "randn(1) AS v")
    wanted = spark.createDataFrame([(0, "a", 499_999)], "k int, name string, rank long")
    found = selection.order_statistics(rows, ["k"], "v", wanted)
    text = found._jdf.queryExecution().toString()
    assert "percentile" not in text and "collect_" not in text and "ObjectHashAggregate" not in text
    assert found.first().x == rows.selectExpr("percentile(v, 499999 / 999999)").first()[0]


def test_scores_are_the_same_either_way(spark):
    from test_report import GOLDEN, relations

    from gaugeline.plans import report as plan

    measured = plan.stages(relations(spark, GOLDEN)).measured
    usual = SC.scored(SC.artist_metrics(measured)).orderBy("artist_id").collect()
    selected = SC.scored(SC.artist_metrics(measured, hot_rows=3), hot_rows=2)
    assert selected.select(*usual[0].asDict()).orderBy("artist_id").collect() == usual
    assert SC.anchors(SC.artist_metrics(measured), Rubric()).count() == 1
