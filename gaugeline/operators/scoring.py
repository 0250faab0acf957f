"""Scores of a run's artists, double tier: one aggregate of videos, one of artists, one projection."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import scoring as S
from gaugeline.operators.selection import HOT_ROWS, percentiles
from gaugeline.plans.config import ReportRules, Rubric
from gaugeline.tables import written


def measured(eligible: DataFrame, runs: DataFrame, rubric: Rubric | None = None, *, strict: bool = True) -> DataFrame:
    """eligible with age (effective), vel, eng and weight; runs: run_id, window_end, not needed by videos that carry it.
    J5's numbers stay with the videos. A video from after the window raises (G15), unless not ``strict``: before it is known
    which videos are eligible, it is taken as of the window's end, and videos without a run stay."""
    rubric = rubric or Rubric()
    timed = eligible if "window_end" in eligible.columns else eligible.join(runs.select("run_id", "window_end"), "run_id", "inner" if strict else "left")
    published = F.col("published_at") if strict else F.least("published_at", "window_end")
    aged = timed.withColumn("age", S.effective_age(S.age_days(published, F.col("window_end")), rubric))
    return aged.withColumn("vel", S.velocity(F.col("views"), F.col("age"))).withColumn("eng", S.engagement_rate(F.col("likes"), F.col("comments"), F.col("views"))).withColumn("weight", S.recency_weight(F.col("age"), rubric))


def publications(rules: ReportRules | None = None) -> list[Column]:
    """Videos in the last days and in as many before; the windows share no instant."""
    rules = rules or ReportRules()
    start = lambda n: F.expr(f"window_end - INTERVAL {n} DAYS")
    recent, prior = start(rules.growth_days), start(2 * rules.growth_days)
    at = F.col("published_at")
    return [F.count_if((at > recent) & (at <= F.col("window_end"))).alias("recent_7d"), F.count_if((at > prior) & (at <= recent)).alias("prior_7d")]


def by_channel(videos: DataFrame, rules: ReportRules | None = None) -> DataFrame:
    """What adds up of an artist's videos, by channel: n, parts of the engagement, publication counts, the fastest video's velocity."""
    rated = F.col("eng").isNotNull()
    weighted, weight = F.sum(F.when(rated, F.col("weight") * F.col("eng"))), F.sum(F.when(rated, F.col("weight")))
    return videos.groupBy("run_id", "artist_id", "channel_id").agg(F.count("video_id").alias("n"), weighted.alias("__weighted"), weight.alias("__weight"), *publications(rules), F.max("vel").alias("fastest"))


def artist_metrics(videos: DataFrame, rules: ReportRules | None = None, *, hot_rows: int = HOT_ROWS, channels: DataFrame | None = None) -> DataFrame:
    """Signals, competition, velocity_median, engagement and publication counts of each artist.

    videos has one row a video (gate G5). What adds up is summed by channel first, which also counts the channels (``channels``: that
    is known), then by artist and written; by its counts the exact median of an artist of more than ``hot_rows`` videos is selected and
    not gathered. Of channels dealt into three parts, each part's fastest video is another one, so the least of the three velocities
    isn't above the artist's third fastest. fast_from is a little below it, for what is rounded to eight decimals; it is null where
    a part has no velocity."""
    key = ["run_id", "artist_id"]
    channels = written(by_channel(videos, rules), "by_channel") if channels is None else channels
    part = F.pmod(F.hash("channel_id"), F.lit(3))
    fastest = [F.max(F.when(part == k, F.col("fastest"))) for k in range(3)]
    least = F.when(fastest[0].isNotNull() & fastest[1].isNotNull() & fastest[2].isNotNull(), F.least(*fastest))
    sums = written(channels.groupBy(*key).agg(
        F.sum("n").alias("signals"),
        F.count("channel_id").alias("competition"),
        F.try_divide(F.sum("__weighted"), F.sum("__weight")).alias("engagement"),
        F.sum("recent_7d").alias("recent_7d"),
        F.sum("prior_7d").alias("prior_7d"),
        (least - 1e-7 - 1e-12 * F.abs(least)).alias("fast_from"),
    ), "sums")
    medians = percentiles(videos, key, "vel", {"velocity_median": 0.5}, hot_rows=hot_rows, sizes=sums.select(*key, F.col("signals").alias("n")))
    return sums.join(medians, key)


def anchors(metrics: DataFrame, rubric: Rubric, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """v_ref and e_ref of each run, the exact percentiles of its artists' velocities and engagements."""
    of = lambda value, name, share: percentiles(metrics, ["run_id"], value, {name: float(share)}, hot_rows=hot_rows)
    return of("velocity_median", "v_ref", rubric.velocity_percentile).join(of("engagement", "e_ref", rubric.engagement_percentile), "run_id")


def scored(metrics: DataFrame, rubric: Rubric | None = None, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Anchors over the run's artists, components, raw and final score.

    The metrics, a row an artist, are written, so the artists are worked out once. The anchors are taken in a window where no
    run has more than ``hot_rows`` artists, and selected and joined where one has."""
    rubric = rubric or Rubric()
    metrics = written(metrics, "metrics")
    if metrics.groupBy("run_id").count().where(F.col("count") > hot_rows).isEmpty():
        run = Window.partitionBy("run_id")
        anchored = metrics.withColumn("v_ref", F.percentile("velocity_median", float(rubric.velocity_percentile)).over(run)).withColumn("e_ref", F.percentile("engagement", float(rubric.engagement_percentile)).over(run))
    else:
        anchored = metrics.join(anchors(metrics, rubric, hot_rows=hot_rows), "run_id")
    with_parts = anchored.select(
        "*",
        S.anchored(F.col("velocity_median"), F.col("v_ref")).alias("norm_velocity"),
        S.anchored(F.col("engagement"), F.col("e_ref")).alias("norm_engagement"),
        S.ln_saturating(F.col("signals"), rubric.signals_cap).alias("norm_signals"),
        S.ln_saturating(F.col("competition"), rubric.diversity_target).alias("norm_diversity"),
    )
    raw = S.raw_score(F.col("norm_velocity"), F.col("norm_signals"), F.col("norm_engagement"), F.col("norm_diversity"), rubric)
    return with_parts.withColumn("raw_score", raw).withColumn("final_score", S.final_score(F.col("raw_score")))


CHUNK = 1000
CHUNKS = "run_id string, artist_id string, chunk long, n long, first_id string, last_id string, body string, chain string"


def rejected_for() -> Column:
    """What a video's numbers are rejected for; null if for nothing."""
    return F.when(F.col("views").isNull(), "views_null").when(F.col("views") == 0, "views_null_or_zero")


def evidence(videos: DataFrame, size: int = CHUNK) -> DataFrame:
    """The accepted videos of each artist in the order of their ids, with what each was rejected for, if anything, in chunks.

    A chunk has ``size`` videos (the last one what is left) as the JSON list ``body``, and ``chain``, the SHA-256 of the chain of the
    chunk before (none for the first) and its own body. So the last chain stands for all of an artist's evidence, however much
    that is; sorted rows stream into chunks, and no list of an artist is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, chain = None, 0, ""
        held: list[tuple] = []

        def done() -> tuple:
            nonlocal chunk, chain
            body = json.dumps([dict(zip(("comments", "likes", "rejected", "video_id", "views"), h, strict=True)) for h in held], separators=(",", ":"), ensure_ascii=False)
            chain = hashlib.sha256((chain + body).encode()).hexdigest()
            row = (*now, chunk, len(held), held[0][3], held[-1][3], body, chain)
            chunk += 1
            held.clear()
            return row

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64() if k in (2, 3) else pa.string()) for k in range(len(names))], names)

        for batch in batches:
            found = []
            for run_id, artist_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (run_id, artist_id) != now:
                    if held:
                        found.append(done())
                    now, chunk, chain = (run_id, artist_id), 0, ""
                held.append(tuple(row))
                if len(held) == size:
                    found.append(done())
            yield batch_of(found)
        if held:
            yield batch_of([done()])

    rows = videos.select("run_id", "artist_id", "comments", "likes", rejected_for().alias("rejected"), "video_id", "views")
    return rows.repartition("run_id", "artist_id").sortWithinPartitions("run_id", "artist_id", "video_id").mapInArrow(run, CHUNKS)


def ranked(scores: DataFrame) -> DataFrame:
    """Rank in the run by score, velocity, signals, then id: a total order. Velocity is compared to ten decimals."""
    order = Window.partitionBy("run_id").orderBy(F.desc("final_score"), F.desc(F.round("norm_velocity", 10)), F.desc(F.round("norm_signals", 10)), "artist_id")
    return scores.withColumn("rank", F.row_number().over(order))
