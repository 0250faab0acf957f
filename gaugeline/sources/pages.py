"""Where the walk along a run's search pages stops, why, and which videos it collected.

Pages are landed already, so the walk is a join: pointer jumping gives each page its step, the first place of each video
says on which step it is new, and a running sum over a run's steps says how many distinct videos there are after each. A
run ends at the first step that gives a reason: the target is reached, there is no next token, or one of the refusals. What
lies behind that step isn't looked at, so a token that leads back after the target is no fault. Windows hold the steps of one
run, which are as many as the ceiling allows and one more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.errors import BlankToken, MissingPage, PageCeiling, PaginationError, RepeatedToken
from gaugeline.sources.raw import PAGE_CEILING, TARGET_VIDEOS, walk_pages
from gaugeline.tables import written

TARGET_REACHED, SOURCE_EXHAUSTED = "target_reached", "source_exhausted"
REFUSALS: dict[str, type[PaginationError]] = {"token_repeated": RepeatedToken, "token_blank": BlankToken, "page_ceiling": PageCeiling, "page_missing": MissingPage}


def first_places(walk: DataFrame, items: DataFrame) -> DataFrame:
    """run_id, video_id, step and item: the first place of each video along the walk. Ids that are empty don't count."""
    token = lambda df: F.coalesce(df["page_token"], F.lit(""))
    visits = walk.where("visit = 1").select("run_id", token(walk).alias("__token"), "step")
    placed = items.where("video_id <> ''").select("run_id", token(items).alias("__token"), "item", "video_id").join(visits, ["run_id", "__token"])
    return placed.groupBy("run_id", "video_id").agg(F.min(F.struct("step", "item")).alias("at")).select("run_id", "video_id", "at.step", "at.item")


def stops(spark: SparkSession, pages: DataFrame, items: DataFrame, *, target: int = TARGET_VIDEOS, ceiling: int = PAGE_CEILING) -> tuple[DataFrame, DataFrame]:
    """(stops, places). stops: run_id, pages (walked), stop_token, reason, n_videos (distinct, up to the target) and refused.

    pages: run_id, page_token (null for the first), next_token. items: run_id, page_token, item, video_id. A page that is
    landed twice counts as a token that leads back. A run without a first page has no row."""
    run = Window.partitionBy("run_id").orderBy("step", "visit")
    reached = walk_pages(spark, pages, ceiling + 1).withColumn("visit", F.row_number().over(Window.partitionBy("run_id", "page_token").orderBy("step")))
    walk = written(reached.withColumn("following", F.lead("step").over(run)), "walk")
    places = written(first_places(walk, items), "places")
    fresh = places.groupBy("run_id", "step").agg(F.count("*").alias("fresh")).withColumn("visit", F.lit(1))
    so_far = walk.join(fresh, ["run_id", "step", "visit"], "left").withColumn("videos", F.sum(F.coalesce("fresh", F.lit(0))).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    reason = (
        F.when(F.col("visit") > 1, "token_repeated")
        .when(F.col("videos") >= target, TARGET_REACHED)
        .when(F.col("next_token").isNull(), SOURCE_EXHAUSTED)
        .when(F.col("next_token") == "", "token_blank")
        .when(F.col("step") >= ceiling, "page_ceiling")
        .when(F.col("following").isNull(), "page_missing")
    )
    walked = F.when(F.col("visit") > 1, F.col("step") - 1).otherwise(F.col("step"))
    told = so_far.withColumn("reason", reason).where("reason IS NOT NULL").select("run_id", F.struct("step", "visit", walked.alias("pages"), "page_token", "reason", "videos").alias("stop"))
    first = told.groupBy("run_id").agg(F.min("stop").alias("stop"))
    found = first.select("run_id", F.col("stop.pages").alias("pages"), F.col("stop.page_token").alias("stop_token"), F.col("stop.reason").alias("reason"), F.least("stop.videos", F.lit(target)).cast("long").alias("n_videos"))
    return found.withColumn("refused", ~F.col("reason").isin(TARGET_REACHED, SOURCE_EXHAUSTED)), places


def collected(found: DataFrame, places: DataFrame, *, target: int = TARGET_VIDEOS) -> DataFrame:
    """run_id, video_id and position of the videos that runs with a good stop collected, in the order of their first places."""
    upto = found.where("NOT refused").select("run_id", F.col("pages").alias("__last"))
    order = Window.partitionBy("run_id").orderBy("step", "item", "video_id")
    return places.join(upto, "run_id").where("step <= __last").withColumn("position", F.row_number().over(order)).where(F.col("position") <= target).select("run_id", "video_id", "position")


def assert_stops(found: DataFrame) -> None:
    """Raises the refusal of the first run that has one; a few of the runs reach the driver."""
    if bad := found.where("refused").orderBy("run_id").limit(5).collect():
        raise REFUSALS[bad[0].reason]("a run's pages have no good stop", runs=[f"{r.run_id}: {r.reason} after {r.pages} pages" for r in bad])
