"""The report: who is shown, HOT tags, competition, the example video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions import scoring as S
from gaugeline.operators.scoring import publications, ranked
from gaugeline.plans.config import PIPELINE_VERSION, RESOLVER_VERSION, FilterRule, ReportRules, Rubric


def shown(scores: DataFrame, rules: ReportRules | None = None) -> DataFrame:
    """The first artists in rank order at or above the gate, with the HOT tag of the first few above its bar.

    The gate keeps a prefix of the ranking, so the ranks stay; the tag too needs no second window."""
    rules = rules or ReportRules()
    top = ranked(scores).where((F.col("final_score") >= rules.shown_from) & (F.col("rank") <= rules.items_most))
    return top.withColumn("tag", F.when((F.col("final_score") > rules.hot_above) & (F.col("rank") <= rules.hot_most), "HOT"))


def publication_counts(videos: DataFrame, rules: ReportRules | None = None) -> DataFrame:
    """Videos of each artist in the last days and in as many before; the windows share no instant."""
    return videos.groupBy("run_id", "artist_id").agg(*publications(rules))


def examples(videos: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of each artist's three fastest videos the latest; views, then the id decide ties. rule_applied says which did.
    Columns named in ``carry`` come along."""
    fast = Window.partitionBy("run_id", "artist_id").orderBy(F.desc_nulls_last(F.round("vel", 8)), "video_id")
    best = Window.partitionBy("run_id", "artist_id").orderBy(F.desc("published_at"), F.desc(F.coalesce("views", F.lit(-1))), "video_id")
    three = videos.withColumn("__place", F.row_number().over(fast)).where("__place <= 3")
    judged = three.select(
        "run_id", "artist_id", "video_id", "published_at", "views",
        F.row_number().over(best).alias("__n"),
        F.lead("published_at").over(best).alias("__next_at"),
        F.lead(F.coalesce("views", F.lit(-1))).over(best).alias("__next_views"),
        *carry,
    )
    rule = F.when(F.col("__next_at").isNull() | (F.col("published_at") != F.col("__next_at")), "primary").when(F.coalesce("views", F.lit(-1)) != F.col("__next_views"), "secondary").otherwise("final")
    return judged.where("__n = 1").select("run_id", "artist_id", F.col("video_id").alias("example_video_id"), rule.alias("rule_applied"), *carry)


def report(scores: DataFrame, videos: DataFrame, artists: DataFrame, rules: ReportRules | None = None) -> DataFrame:
    """The report's rows: the shown artists, a few a run, with the example of each.

    Only videos from an artist's fast_from on can be among its three fastest; the others aren't sorted."""
    rules = rules or ReportRules()
    said = ("rank", "tag", "final_score", "signals", "velocity_median", "competition", "recent_7d", "prior_7d")
    # What is said of the shown artists goes with their videos, so the ranking is worked out and joined once.
    of_shown = videos.join(shown(scores, rules).select("run_id", "artist_id", "fast_from", *said), ["run_id", "artist_id"]).where(F.col("fast_from").isNull() | (F.col("vel") >= F.col("fast_from")))
    joined = examples(of_shown, said).join(artists.select("artist_id", "canonical_name"), "artist_id")
    return joined.select(
        "run_id", "rank", "artist_id",
        F.concat("canonical_name", F.lit(" Type Beat")).alias("title"),
        "tag",
        S.score_display(F.col("final_score"), rules).alias("score_display"),
        F.col("final_score").alias("score_value"),
        "signals",
        S.velocity_display(F.col("velocity_median")).alias("velocity_display"),
        S.competition(F.col("competition"), F.col("recent_7d"), F.col("prior_7d"), rules).alias("competition_level"),
        F.col("competition").alias("competition_channel_count"),
        "example_video_id",
        F.concat(F.lit(S.URL), F.col("example_video_id")).alias("example_url"),
        "rule_applied",
    )


PUBLIC = ("rank", "title", "tag", "score_display", "signals", "velocity_display", "competition_level", "competition_channel_count", "example_url")


def public_view(rows: DataFrame) -> DataFrame:
    """What readers of a report may see."""
    return rows.select("run_id", *PUBLIC)


def stamped(rows: DataFrame, rule: FilterRule | None = None, rubric: Rubric | None = None, rules: ReportRules | None = None) -> DataFrame:
    """Each row with the versions and hashes that made it."""
    rule, rubric, rules = rule or FilterRule(), rubric or Rubric(), rules or ReportRules()
    values = {
        "pipeline_version": PIPELINE_VERSION, "resolver_version": RESOLVER_VERSION, "rule_version": rule.version, "rule_hash": rule.hash,
        "rubric_version": rubric.version, "rubric_hash": rubric.hash, "opportunity_version": rules.version, "opportunity_hash": rules.hash,
    }
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})


def run_status(runs: DataFrame, scores: DataFrame, rules: ReportRules | None = None) -> DataFrame:
    """For each run how many artists were scored and shown, and whether its report is short of opportunities."""
    rules = rules or ReportRules()
    counts = scores.groupBy("run_id").agg(F.count("*").alias("n_scored"), F.count_if(F.col("final_score") >= rules.shown_from).alias("n_qualified"))
    return runs.select("run_id").join(counts, "run_id", "left").select(
        "run_id", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce("n_qualified", F.lit(0)).alias("n_qualified"), (F.coalesce("n_qualified", F.lit(0)) == 0).alias("insufficient")
    )
