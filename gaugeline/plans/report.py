"""The plan from videos to a report: resolve, filter, score, compose. Three aggregates by artist or channel and one window a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gaugeline.functions import text as X
from gaugeline.operators import channels as C
from gaugeline.operators import report as R
from gaugeline.operators import resolution as N
from gaugeline.operators import scoring as S
from gaugeline.errors import CheckViolation, ForeignKeyViolation, GateError, NotNullViolation, UniqueViolation
from gaugeline.operators.gates import assert_empty, blanks, duplicates, several_values
from gaugeline.plans.config import FilterRule, ReportRules, Rubric
from gaugeline.tables import drop_tables, written


@dataclass(frozen=True)
class Relations:
    """runs: run_id, window_end. videos, channels, artists, names: as the operators read them."""

    runs: DataFrame
    videos: DataFrame
    channels: DataFrame
    artists: DataFrame
    names: DataFrame


class Stages:
    """The stages of a plan, each made when it is first asked for.

    The videos, what the rules say of titles, which video has which entity, the sums by channel and the channels' verdicts are
    written once and read from there, so no video is made and no pattern is matched again by what comes after."""

    def __init__(self, relations: Relations, *, rule: FilterRule | None = None, rubric: Rubric | None = None, rules: ReportRules | None = None, facts: DataFrame | None = None, pending: DataFrame | None = None, overrides: DataFrame | None = None, normalize: Callable[[Column], Column] = X.normalize, extract: Callable[[Column], Column] | None = None):
        self.relations, self.rule, self.rubric, self.rules, self.overrides, self.normalize = relations, rule, rubric, rules, overrides, normalize
        self._resolving = {"facts": facts, "pending": pending, "normalize": normalize, "extract": extract}
        self._numbers = ["channel_id", "views", "likes", "comments", "published_at", *(["window_end"] if "window_end" in relations.videos.columns else [])]

    @cached_property
    def videos(self) -> DataFrame:
        """The videos with what goes on of them, written."""
        return written(self.relations.videos.select("run_id", "video_id", "source_title", *self._numbers), "videos")

    @cached_property
    def judged(self) -> DataFrame:
        return written(N.judge_titles(self.__dict__.get("videos", self.relations.videos), N.name_index(self.relations.names, self.normalize), self.normalize), "titles")

    @cached_property
    def outcomes(self) -> DataFrame:
        return N.resolve(self.relations.videos, self.relations.names, carry=self._numbers, judged=self.judged, **self._resolving)

    @cached_property
    def resolved(self) -> DataFrame:
        """What goes on of the outcomes, for all videos."""
        videos = self.videos
        return N.resolve(videos, self.relations.names, carry=self._numbers, judged=self.judged, **self._resolving).select("run_id", "video_id", "decision", "needs_review", "artist_id", *self._numbers)

    @cached_property
    def mapped(self) -> DataFrame:
        return written(N.final_mappings(self.resolved, self._numbers), "mapped")

    @cached_property
    def by_channel(self) -> DataFrame:
        """The sums of each artist's videos by channel, of all channels: the verdicts come from their counts."""
        return written(S.by_channel(S.measured(self.mapped, self.relations.runs, self.rubric, strict=False), self.rules), "by_channel")

    @cached_property
    def verdicts(self) -> DataFrame:
        """Raises if a mapped channel has no record (G12): without one nothing can be said of it."""
        assert_empty(C.missing_records(self.by_channel, self.relations.channels), "every channel has a record", ForeignKeyViolation)
        return written(C.verdicts(self.by_channel, self.relations.channels, self.relations.names, rule=self.rule, overrides=self.overrides, normalize=self.normalize), "verdicts")

    @cached_property
    def barred(self) -> DataFrame:
        return written(C.barred(self.verdicts), "barred")

    @cached_property
    def eligible(self) -> DataFrame:
        return C.without(self.mapped, self.barred)

    @cached_property
    def measured(self) -> DataFrame:
        return S.measured(self.eligible, self.relations.runs, self.rubric)

    @cached_property
    def scores(self) -> DataFrame:
        return S.scored(S.artist_metrics(self.measured, self.rules, channels=C.without(self.by_channel, self.barred)), self.rubric)

    def drop(self) -> None:
        """Removes the tables that were written for the stages asked for so far; their frames can't be read after that."""
        for name in ("judged", "resolved", "videos", "mapped", "by_channel", "verdicts", "barred", "scores"):
            if name in self.__dict__:
                drop_tables(self.__dict__.pop(name))


def stages(r: Relations, **options) -> Stages:  # noqa: ANN003
    return Stages(r, **options)


def check(r: Relations, videos: DataFrame | None = None) -> None:
    """The gates before a run (G5, G13, A14): keys once and none blank, times known. All gates are one job; the first broken one
    in their order raises its class of error. videos: the same videos, if they are written somewhere.

    Equal keys have equal hashes, so videos are counted by a hash of their key. Only if one comes twice, or a row is blank, are
    they counted by the keys themselves, which tells two keys of one hash from one key, and which row broke which gate."""
    own = r.videos if videos is None else videos
    blank = F.bool_or((F.coalesce(F.trim("run_id"), F.lit("")) == "") | (F.coalesce(F.trim("video_id"), F.lit("")) == "") | (F.coalesce(F.trim("channel_id"), F.lit("")) == "") | F.col("published_at").isNull())
    by_video = own.groupBy("run_id", "video_id").agg(F.count("*").alias("n"), blank.alias("blank"))
    window: tuple[str, type[GateError], DataFrame] = ("one window a run", CheckViolation, several_values(own, ["run_id"], ["window_end"])) if "window_end" in own.columns else ("one row a run", UniqueViolation, duplicates(r.runs, ["run_id"]))
    rules: list[tuple[str, type[GateError], DataFrame]] = [
        ("one row a video, with its channel and time", UniqueViolation, by_video.where("n <> 1")),
        ("one row a video, with its channel and time", NotNullViolation, by_video.where("n = 1 AND blank")),
        ("one row a channel", UniqueViolation, duplicates(r.channels, ["channel_id"])),
        window,
        ("one row an artist", UniqueViolation, duplicates(r.artists, ["artist_id"])),
        ("every artist has a name", NotNullViolation, blanks(r.artists, ["artist_id", "canonical_name"])),
    ]

    def broken(frames: list[DataFrame]) -> list[Row]:
        told = reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("gate"), F.to_json(F.struct("*")).alias("row")) for k, df in enumerate(frames)))
        return told.groupBy("gate").agg(F.min("row").alias("row")).orderBy("gate").collect()

    by_hash = own.groupBy(F.xxhash64("run_id", "video_id").alias("hash")).agg(F.count("*").alias("n"), blank.alias("blank"))
    exact = [df for _, _, df in rules]
    if broken([by_hash.where("n <> 1 OR blank"), *exact[2:]]) and (rows := broken(exact)):
        name, error, _ = rules[rows[0].gate]
        raise error(name, row=rows[0]["row"])


def report(r: Relations, *, rules: ReportRules | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Each run's report rows. The gates come first; rows that break one raise, and there is no report."""
    s = stages(r, rules=rules, **options)
    check(r, s.videos)
    return R.report(s.scores, s.measured, r.artists, rules)
