"""The double tier of the score: plain arithmetic that Catalyst can fold, push and generate code for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline.errors import FutureVideo, refuse
from gaugeline.plans.config import ReportRules, Rubric

RUBRIC, RULES = Rubric(), ReportRules()
DAY = 86_400_000_000
URL = "https://www.youtube.com/watch?v="


def age_days(published: Column, window_end: Column) -> Column:
    """exact microseconds over a day; a video from after the window raises."""
    micros = F.unix_micros(window_end) - F.unix_micros(published)
    return F.when(micros < 0, refuse(FutureVideo, "published after the window's end").cast("double")).otherwise(micros / F.lit(float(DAY)))


def effective_age(age: Column, rubric: Rubric = RUBRIC) -> Column:
    """F8."""
    return F.greatest(age, F.lit(float(rubric.age_floor_days)))


def velocity(views: Column, age: Column) -> Column:
    """null for null views, which are never taken for 0."""
    return views / age


def engagement_rate(likes: Column, comments: Column, views: Column) -> Column:
    """undefined without views; missing likes or comments add nothing."""
    return F.when(views > 0, (F.coalesce(likes, F.lit(0)) + F.coalesce(comments, F.lit(0))) / views)


def recency_weight(age: Column, rubric: Rubric = RUBRIC) -> Column:
    """F11."""
    return F.exp(F.lit(math.log(0.5)) * age / F.lit(float(rubric.half_life_days)))


def ln_saturating(n: Column, cap: int) -> Column:
    """F12."""
    return F.least(F.lit(1.0), F.log(1 + n) / F.lit(math.log(1 + cap)))


def anchored(value: Column, anchor: Column) -> Column:
    """F13."""
    return F.when(value.isNotNull() & (anchor > 0), F.least(F.lit(1.0), value / anchor)).otherwise(0.0)


def raw_score(velocity: Column, signals: Column, engagement: Column, diversity: Column, rubric: Rubric = RUBRIC) -> Column:
    """F14."""
    return 100 * (float(rubric.velocity) * velocity + float(rubric.signals) * signals + float(rubric.engagement) * engagement + float(rubric.diversity) * diversity)


def final_score(raw: Column) -> Column:
    """half up. The tenth decimal is taken first, so that a sum that is a half up to its last bits counts as one."""
    return F.floor(F.round(raw, 10) + 0.5).cast("int")


def base_competition(channels: Column, rules: ReportRules = RULES) -> Column:
    """F16."""
    return F.when(channels <= rules.low_channels, "Low").when(channels <= rules.high_channels, "Medium").otherwise("High")


def growth(recent: Column, prior: Column) -> Column:
    """null where there is nothing before."""
    return F.try_divide(recent - prior, prior)


def competition(channels: Column, recent: Column, prior: Column, rules: ReportRules = RULES) -> Column:
    """Growth raises to High and never lowers."""
    return F.when(F.coalesce(growth(recent, prior) > float(rules.growth_above), F.lit(False)), "High").otherwise(base_competition(channels, rules))


def velocity_display(value: Column) -> Column:
    """the threshold is tested before rounding."""
    exact = value.cast("decimal(30,10)")
    return F.when(value >= 1000, F.concat(F.round(exact / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("k/day"))).when(
        value.isNotNull(), F.concat(F.round(exact, 0).cast("decimal(20,0)").cast("string"), F.lit("/day"))
    )


def score_display(score: Column, rules: ReportRules = RULES) -> Column:
    """F19."""
    return F.when(score >= rules.shown_from, F.concat(score.cast("string"), F.lit("/100")))
