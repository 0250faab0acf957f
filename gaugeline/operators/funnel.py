"""Event-log metrics (E1-E9): one conditional aggregate over the log, no self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 15  # below so many producers a ratio only shows a direction
GOALS = {"declared_intent": 0.30, "followup_confirmed": 0.50, "positive_wtp": 0.25, "hot_usefulness": 0.60, "open_rate": 0.70}


def _who(*kinds: str) -> Column:
    return F.countDistinct(F.when(F.col("event_type").isin(*kinds), F.col("producer_id")))


def ratios(events: DataFrame) -> DataFrame:
    """E1-E3 and E6 in one row: distinct producers or events over each other, null where nobody could."""
    counts = events.agg(
        _who("report_opened").alias("opened"),
        _who("intent_to_produce_declared").alias("declared"),
        F.count_if(F.col("event_type") == "intent_to_produce_declared").alias("intents"),
        F.count_if(F.col("event_type") == "followup_confirmed_produced").alias("confirmed"),
        _who("wtp_yes").alias("wtp_yes"),
        _who("wtp_yes", "wtp_no").alias("wtp_any"),
    )
    return counts.select(
        "*",
        F.try_divide("declared", "opened").alias("declared_intent"),
        F.try_divide("confirmed", "intents").alias("followup_confirmed"),
        F.try_divide("wtp_yes", "wtp_any").alias("positive_wtp"),
        (F.col("opened") < SMALL).alias("directional_only"),
    )


def hot_usefulness(events: DataFrame) -> DataFrame:
    """HOT items marked useful over HOT items viewed, an item being an artist in a report."""
    hot = events.where("tag = 'HOT'").groupBy("report_id", "artist_id").agg(F.bool_or(F.col("event_type") == "report_opened").alias("viewed"), F.bool_or(F.col("event_type") == "opportunity_marked_useful").alias("useful"))
    return hot.agg(F.count_if("viewed").alias("viewed"), F.count_if(F.col("viewed") & F.col("useful")).alias("useful")).select("*", F.try_divide("useful", "viewed").alias("hot_usefulness"))


def open_rate(approved: DataFrame, events: DataFrame) -> DataFrame:
    """E5: approved producers who opened a report over all approved ones."""
    opened = events.where("event_type = 'report_opened'").select("producer_id").distinct().withColumn("__open", F.lit(True))
    return approved.select("producer_id").distinct().join(opened, "producer_id", "left").agg(F.count("*").alias("approved"), F.count("__open").alias("opened")).select("*", F.try_divide("opened", "approved").alias("open_rate"))


def first_intents(events: DataFrame) -> DataFrame:
    """The first intent of each producer, artist and report; the id decides between equal times."""
    first = events.where("event_type = 'intent_to_produce_declared'").groupBy("producer_id", "artist_id", "report_id").agg(F.min(F.struct("created_at", "event_id")).alias("f"))
    return first.select("producer_id", "artist_id", "report_id", F.col("f.event_id").alias("event_id"), F.col("f.created_at").alias("created_at"))


def scheduled_followups(intents: DataFrame, days: int = 10) -> DataFrame:
    """A follow-up for each intent, pending, due so many days (10 to 14) after it."""
    return intents.withColumn("due_at", F.col("created_at") + F.expr(f"INTERVAL {days} DAYS")).withColumn("status", F.lit("pending"))


def due_followups(followups: DataFrame, now: str) -> DataFrame:
    """Follow-ups that are pending and due; those sent, answered or missed aren't. The clock is given, never read."""
    return followups.where((F.col("status") == "pending") & (F.col("due_at") <= F.lit(now).cast("timestamp")))


def latest_wtp(events: DataFrame) -> DataFrame:
    """Each producer's latest answer on paying."""
    order = Window.partitionBy("producer_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return events.where("event_type IN ('wtp_yes', 'wtp_no')").withColumn("__n", F.row_number().over(order)).where("__n = 1").select("producer_id", "event_id", (F.col("event_type") == "wtp_yes").alias("would_pay"))


def advance(events: DataFrame) -> DataFrame:
    """Whether enough producers and all three ratios say to go on."""
    r = ratios(events)
    ok = lambda name: F.coalesce(F.col(name) >= GOALS[name], F.lit(False))
    return r.select("opened", ((F.col("opened") >= SMALL) & ok("declared_intent") & ok("followup_confirmed") & ok("positive_wtp")).alias("advance"))
