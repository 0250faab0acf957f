"""Channel footprints, verdicts and what is left of each entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import text as X
from gaugeline.plans.config import FilterRule
from gaugeline.tables import written


def mapped_videos(videos: DataFrame, mappings: DataFrame) -> DataFrame:
    """The videos that have a final mapping, with the entity."""
    return videos.join(mappings, ["run_id", "video_id"])


def counted(mapped: DataFrame) -> DataFrame:
    """Videos by artist and channel; a mapping is one row a video (gate G5), so no set of them is made."""
    return mapped.groupBy("run_id", "channel_id", "artist_id").agg(F.count("video_id").alias("n"))


def footprint(mapped: DataFrame) -> DataFrame:
    """A1 and A2: run_id, channel_id, run_videos and the sorted ids of linked artists."""
    return counted(mapped).groupBy("run_id", "channel_id").agg(F.sum("n").alias("run_videos"), F.array_sort(F.collect_list("artist_id")).alias("artist_ids"))


def missing_records(mapped: DataFrame, channels: DataFrame) -> DataFrame:
    """Mapped channels without a record; must be empty."""
    return mapped.select("run_id", "channel_id").distinct().join(channels.select("channel_id").distinct(), "channel_id", "left_anti")


def self_channels(mapped: DataFrame, channels: DataFrame, names: DataFrame, normalize: Callable[[Column], Column] = X.normalize) -> DataFrame:
    """(run_id, channel_id) whose title is, normalised, a name of any artist that it is linked to."""
    links = mapped.select("run_id", "channel_id", "artist_id").distinct()
    titles = channels.select("channel_id", normalize(F.col("title")).alias("name")).where("name <> ''")
    named = names.select("artist_id", normalize(F.col("name")).alias("name")).distinct()
    return links.join(titles, "channel_id").join(named, ["artist_id", "name"]).select("run_id", "channel_id").distinct()


def verdicts(mapped: DataFrame, channels: DataFrame, names: DataFrame, *, rule: FilterRule | None = None, overrides: DataFrame | None = None, normalize: Callable[[Column], Column] = X.normalize) -> DataFrame:
    """Override, then self channel, then domination of the run, else eligible. overrides: channel_id, is_eligible.

    mapped: a row a video, or a row an artist and channel of a run with its number of videos ``n``."""
    rule = rule or FilterRule()
    # Channels that bear an artist's name are few and written, so they go to the counts, which aren't shuffled for them; a channel's
    # counts are then summed, without a list of its artists.
    titles = channels.select("channel_id", normalize(F.col("title")).alias("__title")).where("__title <> ''")
    named = names.select("artist_id", normalize(F.col("name")).alias("__title"))
    own = written(titles.join(named, "__title").select("channel_id", "artist_id").distinct(), "own").withColumn("__own", F.lit(True))
    counts = mapped.select("run_id", "channel_id", "artist_id", "n") if "n" in mapped.columns else counted(mapped)
    seen = counts.join(own, ["channel_id", "artist_id"], "left").groupBy("run_id", "channel_id").agg(F.sum("n").alias("run_videos"), F.coalesce(F.bool_or("__own"), F.lit(False)).alias("__self"))
    if overrides is not None:
        seen = seen.join(overrides.select("channel_id", F.col("is_eligible").alias("__override")), "channel_id", "left")
    else:
        seen = seen.withColumn("__override", F.lit(None).cast("boolean"))
    reason = F.when(F.col("__override").isNotNull(), "human_override").when(F.col("__self"), "self_channel").when(F.col("run_videos") > rule.most_videos, "run_domination").otherwise("eligible")
    return seen.select("run_id", "channel_id", "run_videos", reason.alias("reason_code"), F.coalesce(F.col("__override"), reason == "eligible").alias("is_eligible"))


def eligible_videos(mapped: DataFrame, decided: DataFrame) -> DataFrame:
    """Videos of channels whose verdict is true; a channel without one is out."""
    return mapped.join(decided.where("is_eligible").select("run_id", "channel_id"), ["run_id", "channel_id"], "left_semi")


def barred(decided: DataFrame) -> DataFrame:
    """The channels of runs whose verdict is false."""
    return decided.where("NOT is_eligible").select("run_id", "channel_id")


def without(rows: DataFrame, out: DataFrame) -> DataFrame:
    """P6 where every channel of the rows has a verdict: the rows but for the channels that are out, which are far fewer."""
    return rows.where("run_id IS NOT NULL AND channel_id IS NOT NULL").join(out, ["run_id", "channel_id"], "left_anti")


def projections(eligible: DataFrame) -> DataFrame:
    """A3 and A4: signals and competition, distinct videos and channels of each artist of a run."""
    return eligible.groupBy("run_id", "artist_id").agg(F.countDistinct("video_id").alias("signals"), F.countDistinct("channel_id").alias("competition"))
