"""The registered queries over the driver's tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import scoring as S
from gaugeline.functions import text as X
from gaugeline.operators import channels as C
from gaugeline.operators import exact, funnel, gates, locators, replay, selection
from gaugeline.operators import report as R
from gaugeline.operators import resolution as N
from gaugeline.operators import scoring as SC
from gaugeline.plans import adapter as A
from gaugeline.plans import report as plan
from gaugeline.plans.config import COMPARISON_CONTRACT, OPPORTUNITY_VERSION, PIPELINE_VERSION, RESOLVER_VERSION, RUBRIC_VERSION, RULE_VERSION, FilterRule, ReportRules, Rubric
from gaugeline.plans import session
from gaugeline.sources import landed, raw, store
from gaugeline.sources import pages as P
from gaugeline.streaming import quota
from gaugeline.tables import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


# ---- relations -----------------------------------------------------------------------------------------------


def videos_of(spark: SparkSession, d: str) -> DataFrame:
    return A.relation(spark, d, A.VIDEOS)


def relations(spark: SparkSession, d: str, run: str = "run_id") -> plan.Relations:
    """The titles are ASCII by construction, so normalising them needs no Python."""
    v = videos_of(spark, d)
    if run != "run_id":
        v = v.withColumn("run_id", F.col(run)).withColumn("window_end", F.expr("CAST(date_trunc('year', published_at) + INTERVAL '1' YEAR AS TIMESTAMP)"))
    runs = v.groupBy("run_id").agg(F.max("window_end").alias("window_end"))
    return plan.Relations(runs, v.drop("year_id"), A.relation(spark, d, A.CHANNELS), A.relation(spark, d, A.ARTISTS), A.relation(spark, d, A.NAMES))


def stages_of(spark: SparkSession, d: str, run: str = "run_id") -> plan.Stages:
    return plan.stages(relations(spark, d, run), normalize=X.normalize_ascii)


def events_of(spark: SparkSession, d: str) -> DataFrame:
    return A.relation(spark, d, A.EVENTS)


# ---- the same in DuckDB ----------------------------------------------------------------------------------------

NORM = "coalesce(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '')"
norm = NORM.format


def base(run: str = "run_id", end: str = "window_end") -> str:
    return f"""
WITH all_videos AS ({A.duck(A.VIDEOS)}),
videos AS (SELECT * REPLACE ({run} AS run_id, {end} AS window_end) FROM all_videos),
artists AS ({A.duck(A.ARTISTS)}), names AS ({A.duck(A.NAMES)}), channels AS ({A.duck(A.CHANNELS)}),
idx AS (SELECT {norm("name")} AS n, list_sort(list(DISTINCT artist_id)) AS ids FROM names GROUP BY 1),
att AS (
  SELECT *, {norm("source_title")} AS nt, len(regexp_extract_all(coalesce(source_title, ''), '(?i)\\btype\\s+beat\\b')) AS m,
    trim(regexp_replace(regexp_extract(coalesce(source_title, ''), '(?is)^(.*?)\\btype\\s+beat\\b', 1), '(?s)^.*(\\||:|\\]|\\)|\\s[-–—]\\s)', '')) AS cand
  FROM videos),
tried AS (
  SELECT att.*, ids, {norm("cand")} AS nc, CASE WHEN nt = '' THEN 'source_title_missing' WHEN m = 0 THEN 'regex_no_match'
    WHEN m > 1 THEN 'regex_multiple_matches' WHEN cand = '' THEN 'regex_empty_candidate'
    WHEN {norm("cand")} = '' OR strpos(' ' || nt || ' ', ' ' || {norm("cand")} || ' ') = 0 THEN 'candidate_outside_source_title'
    WHEN regexp_matches(cand, '(?i)\\b(x|feat\\.?|ft\\.?)\\s|\\s(x|feat\\.?|ft\\.?)\\b|[&/,]') THEN 'regex_multiple_artists'
    WHEN regexp_matches(cand, '(?i)\\b(free|prod(uced)?|bpm|key|lease|licen[cs]e|buy|price)\\b|\\b(19|20)\\d{{2}}\\b|\\b\\d{{2,3}}\\s*bpm\\b|\\b[a-g](#|b)?\\s*(maj(or)?|min(or)?)\\b|[$€£]|[\\[\\](){{}}]') THEN 'regex_metadata_residual'
    WHEN len(ids) > 1 THEN 'artist_alias_collision' ELSE 'regex_autoaccepted' END AS rule_reason
  FROM att LEFT JOIN idx ON {norm("cand")} = idx.n),
mapped AS (SELECT *, ids[1] AS artist_id FROM tried WHERE rule_reason = 'regex_autoaccepted' AND len(ids) = 1),
foot AS (SELECT run_id, channel_id, count(DISTINCT video_id) AS run_videos, list_sort(list(DISTINCT artist_id)) AS artist_ids FROM mapped GROUP BY ALL),
selfs AS (SELECT DISTINCT m.run_id, m.channel_id FROM mapped m JOIN channels c USING (channel_id)
  JOIN names n ON n.artist_id = m.artist_id AND {norm("n.name")} = {norm("c.title")} WHERE {norm("c.title")} <> ''),
verdicts AS (SELECT f.run_id, f.channel_id, run_videos, CASE WHEN s.channel_id IS NOT NULL THEN 'self_channel'
    WHEN run_videos > 60 THEN 'run_domination' ELSE 'eligible' END AS reason_code
  FROM foot f LEFT JOIN selfs s ON s.run_id = f.run_id AND s.channel_id = f.channel_id),
measured AS (
  SELECT m.*, greatest(1.0, epoch_us(window_end - published_at) / 86400e6) AS age FROM mapped m
  JOIN verdicts v ON v.run_id = m.run_id AND v.channel_id = m.channel_id AND v.reason_code = 'eligible'),
rated AS (SELECT *, views / age AS vel, CASE WHEN views > 0 THEN (coalesce(likes, 0) + coalesce(comments, 0)) / views END AS eng,
  exp(ln(0.5) * age / 15) AS weight FROM measured),
metrics AS (
  SELECT run_id, artist_id, count(DISTINCT video_id) AS signals, count(DISTINCT channel_id) AS competition, median(vel) AS velocity_median,
    sum(weight * eng) FILTER (eng IS NOT NULL) / nullif(sum(weight) FILTER (eng IS NOT NULL), 0) AS engagement
  FROM rated GROUP BY ALL),
parts AS (
  SELECT *, quantile_cont(velocity_median, 0.9) OVER (PARTITION BY run_id) AS v_ref, quantile_cont(engagement, 0.9) OVER (PARTITION BY run_id) AS e_ref,
    least(1.0, ln(1 + signals) / ln(21)) AS norm_signals, least(1.0, ln(1 + competition) / ln(16)) AS norm_diversity
  FROM metrics),
normed AS (
  SELECT *, CASE WHEN velocity_median IS NOT NULL AND v_ref > 0 THEN least(1.0, velocity_median / v_ref) ELSE 0.0 END AS norm_velocity,
    CASE WHEN engagement IS NOT NULL AND e_ref > 0 THEN least(1.0, engagement / e_ref) ELSE 0.0 END AS norm_engagement FROM parts),
scores AS (
  SELECT *, floor(round(100 * (0.4 * norm_velocity + 0.25 * norm_signals + 0.2 * norm_engagement + 0.15 * norm_diversity), 10) + 0.5)::INTEGER AS final_score
  FROM normed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY final_score DESC, round(norm_velocity, 10) DESC, round(norm_signals, 10) DESC, artist_id)::INTEGER AS rank FROM scores),
shown AS (SELECT *, CASE WHEN final_score > 90 AND rank <= 2 THEN 'HOT' END AS tag FROM ranked WHERE final_score >= 83 AND rank <= 10),
counts AS (
  SELECT run_id, artist_id, count(*) FILTER (published_at > window_end - INTERVAL 7 DAY AND published_at <= window_end) AS recent_7d,
    count(*) FILTER (published_at > window_end - INTERVAL 14 DAY AND published_at <= window_end - INTERVAL 7 DAY) AS prior_7d
  FROM rated GROUP BY ALL),
three AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY run_id, artist_id ORDER BY round(vel, 8) DESC NULLS LAST, video_id) <= 3),
judged AS (
  SELECT *, row_number() OVER w AS n, lead(published_at) OVER w AS next_at, lead(coalesce(views, -1)) OVER w AS next_views FROM three
  WINDOW w AS (PARTITION BY run_id, artist_id ORDER BY published_at DESC, coalesce(views, -1) DESC, video_id)),
examples AS (
  SELECT run_id, artist_id, video_id AS example_video_id, CASE WHEN next_at IS NULL OR published_at <> next_at THEN 'primary'
    WHEN coalesce(views, -1) <> next_views THEN 'secondary' ELSE 'final' END AS rule_applied FROM judged WHERE n = 1),
report AS (
  SELECT s.run_id, s.rank, s.artist_id, a.canonical_name || ' Type Beat' AS title, tag, final_score || '/100' AS score_display, final_score AS score_value, signals,
    CASE WHEN velocity_median >= 1000 THEN round(velocity_median::DECIMAL(30, 10) / 1000, 1)::DECIMAL(20, 1) || 'k/day' ELSE round(velocity_median::DECIMAL(30, 10), 0)::DECIMAL(20, 0) || '/day' END AS velocity_display,
    CASE WHEN prior_7d > 0 AND (recent_7d - prior_7d) / prior_7d > 0.5 THEN 'High' WHEN competition <= 5 THEN 'Low' WHEN competition <= 15 THEN 'Medium' ELSE 'High' END AS competition_level,
    competition AS competition_channel_count, example_video_id, 'https://www.youtube.com/watch?v=' || example_video_id AS example_url, rule_applied
  FROM shown s JOIN counts USING (run_id, artist_id) JOIN examples USING (run_id, artist_id) JOIN artists a USING (artist_id))
"""


YEAR = base("year_id", "(date_trunc('year', published_at) + INTERVAL 1 YEAR)::TIMESTAMP")
BASE = base()
EV = f"WITH ev AS ({A.duck(A.EVENTS)}) "

# ---- resolution --------------------------------------------------------------------------------------------------


@query(
    "resolve_videos",
    BASE + """SELECT run_id, video_id, CASE rule_reason WHEN 'regex_autoaccepted' THEN 'regex' WHEN 'candidate_outside_source_title' THEN 'regex' ELSE 'unknown' END AS method,
  CASE WHEN rule_reason IN ('regex_autoaccepted', 'candidate_outside_source_title') THEN cand END AS candidate,
  CASE rule_reason WHEN 'regex_autoaccepted' THEN 'accepted' WHEN 'candidate_outside_source_title' THEN 'rejected' WHEN 'source_title_missing' THEN 'rejected' ELSE 'review_required' END AS decision,
  CASE WHEN rule_reason IN ('regex_autoaccepted', 'candidate_outside_source_title', 'source_title_missing') THEN rule_reason ELSE 'llm_unavailable' END AS reason_code,
  CASE WHEN rule_reason = 'regex_autoaccepted' AND len(ids) = 1 THEN ids[1] END AS artist_id, rule_reason FROM tried""",
)
def resolve_videos(spark: SparkSession, d: str) -> DataFrame:
    return stages_of(spark, d).outcomes.select("run_id", "video_id", "method", "candidate", "decision", "reason_code", "artist_id", "rule_reason")


@query("resolution_reasons", BASE + "SELECT rule_reason, count(*) AS n, count(DISTINCT run_id) AS runs FROM tried GROUP BY ALL")
def resolution_reasons(spark: SparkSession, d: str) -> DataFrame:
    return stages_of(spark, d).outcomes.groupBy("rule_reason").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))


@query("name_index", BASE + "SELECT n AS name, array_to_string(ids, ',') AS artist_ids, len(ids) > 1 AS collides FROM idx WHERE n <> ''")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    return N.name_index(A.relation(spark, d, A.NAMES), X.normalize_ascii).select("name", F.array_join("artist_ids", ",").alias("artist_ids"), (F.size("artist_ids") > 1).alias("collides"))


@query(
    "title_functions",
    BASE + f"""SELECT DISTINCT source_title, {norm("source_title")} AS normal, len(regexp_extract_all(source_title, '(?i)\\btype\\s+beat\\b')) AS markers, cand AS candidate,
  nc <> '' AND strpos(' ' || nt || ' ', ' ' || nc || ' ') > 0 AS supported, trim(source_title) <> '' AS filled FROM tried WHERE source_title IS NOT NULL""",
)
def title_functions(spark: SparkSession, d: str) -> DataFrame:
    """F1-F4 and F25, on distinct titles; normalize() also takes titles that aren't ASCII."""
    t = videos_of(spark, d).select("source_title").where("source_title IS NOT NULL").distinct()
    c = t.select("source_title", X.normalize(F.col("source_title")).alias("normal"), X.marker_count(F.col("source_title")).cast("long").alias("markers"), X.candidate(F.col("source_title")).alias("candidate"), X.non_blank(F.col("source_title")).alias("filled"))
    return c.withColumn("supported", X.is_supported(X.normalize_ascii(F.col("candidate")), F.col("normal")))


# ---- channels ------------------------------------------------------------------------------------------------------


@query("channel_verdicts", YEAR + "SELECT run_id, channel_id, run_videos, reason_code, reason_code = 'eligible' AS is_eligible FROM verdicts")
def channel_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return stages_of(spark, d, "year_id").verdicts


@query("channel_footprint", YEAR + "SELECT run_id, channel_id, run_videos, array_to_string(artist_ids, ',') AS artist_ids FROM foot")
def channel_footprint(spark: SparkSession, d: str) -> DataFrame:
    return C.footprint(stages_of(spark, d, "year_id").mapped).select("run_id", "channel_id", "run_videos", F.array_join("artist_ids", ",").alias("artist_ids"))


@query("mapped_videos", BASE + "SELECT run_id, video_id, artist_id, channel_id, views FROM mapped")
def mapped_videos(spark: SparkSession, d: str) -> DataFrame:
    """J1."""
    s = stages_of(spark, d)
    return C.mapped_videos(s.relations.videos, N.final_mappings(s.outcomes)).select("run_id", "video_id", "artist_id", "channel_id", "views")


@query("artist_projections", BASE + "SELECT run_id, artist_id, count(DISTINCT video_id) AS signals, count(DISTINCT channel_id) AS competition FROM measured GROUP BY ALL")
def artist_projections(spark: SparkSession, d: str) -> DataFrame:
    return C.projections(stages_of(spark, d).eligible)


@query(
    "channel_overrides",
    YEAR + "SELECT run_id, channel_id, 'human_override' AS reason_code, regexp_extract(channel_id, '[0-9]+')::BIGINT % 2 = 0 AS is_eligible FROM verdicts WHERE regexp_extract(channel_id, '[0-9]+')::BIGINT % 10 < 2",
)
def channel_overrides(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d, "year_id")
    number = F.regexp_extract("channel_id", "[0-9]+", 0).cast("long")
    people = r.channels.where(number % 10 < 2).select("channel_id", (number % 2 == 0).alias("is_eligible"))
    return plan.stages(r, overrides=people, normalize=X.normalize_ascii).verdicts.where("reason_code = 'human_override'").select("run_id", "channel_id", "reason_code", "is_eligible")


# ---- scores and report -------------------------------------------------------------------------------------------


@query("video_measures", BASE + "SELECT run_id, video_id, artist_id, round(age, 6) AS age, vel, eng, round(weight, 8) AS weight FROM rated")
def video_measures(spark: SparkSession, d: str) -> DataFrame:
    m = stages_of(spark, d).measured
    return m.select("run_id", "video_id", "artist_id", F.round("age", 6).alias("age"), "vel", "eng", F.round("weight", 8).alias("weight"))


@query("artist_metrics", BASE + "SELECT run_id, artist_id, signals, competition, round(velocity_median, 4) AS velocity_median, round(engagement, 8) AS engagement FROM metrics")
def artist_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = SC.artist_metrics(stages_of(spark, d).measured)
    return m.select("run_id", "artist_id", "signals", "competition", F.round("velocity_median", 4).alias("velocity_median"), F.round("engagement", 8).alias("engagement"))


@query(
    "artist_scores",
    BASE + """SELECT run_id, artist_id, round(v_ref, 4) AS v_ref, round(e_ref, 8) AS e_ref, round(norm_velocity, 8) AS norm_velocity, round(norm_signals, 8) AS norm_signals,
  round(norm_engagement, 8) AS norm_engagement, round(norm_diversity, 8) AS norm_diversity, final_score FROM scores""",
)
def artist_scores(spark: SparkSession, d: str) -> DataFrame:
    s = stages_of(spark, d).scores
    return s.select("run_id", "artist_id", F.round("v_ref", 4).alias("v_ref"), *(F.round(c, 8).alias(c) for c in ("e_ref", "norm_velocity", "norm_signals", "norm_engagement", "norm_diversity")), "final_score")


@query("run_ranking", BASE + "SELECT run_id, rank, artist_id, final_score FROM ranked")
def run_ranking(spark: SparkSession, d: str) -> DataFrame:
    return SC.ranked(stages_of(spark, d).scores).select("run_id", "rank", "artist_id", "final_score")


@query("publication_counts", BASE + "SELECT run_id, artist_id, recent_7d, prior_7d FROM counts")
def publication_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.publication_counts(stages_of(spark, d).measured)


@query("example_videos", BASE + "SELECT * FROM examples")
def example_videos(spark: SparkSession, d: str) -> DataFrame:
    return R.examples(stages_of(spark, d).measured)


@query("report_rows", BASE + "SELECT * FROM report")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    return plan.report(relations(spark, d), normalize=X.normalize_ascii)


@query("report_public", BASE + "SELECT run_id, rank, title, tag, score_display, signals, velocity_display, competition_level, competition_channel_count, example_url FROM report")
def report_public(spark: SparkSession, d: str) -> DataFrame:
    return R.public_view(plan.report(relations(spark, d), normalize=X.normalize_ascii))


@query(
    "report_stamped",
    BASE + f"""SELECT run_id, artist_id, '{PIPELINE_VERSION}' AS pipeline_version, '{RESOLVER_VERSION}' AS resolver_version, '{RULE_VERSION}' AS rule_version, '{FilterRule().hash}' AS rule_hash,
  '{RUBRIC_VERSION}' AS rubric_version, '{Rubric().hash}' AS rubric_hash, '{OPPORTUNITY_VERSION}' AS opportunity_version, '{ReportRules().hash}' AS opportunity_hash FROM shown""",
)
def report_stamped(spark: SparkSession, d: str) -> DataFrame:
    return R.stamped(R.shown(stages_of(spark, d).scores).select("run_id", "artist_id"))


@query(
    "run_status",
    BASE + """SELECT r.run_id, count(s.artist_id) AS n_scored, count(*) FILTER (s.final_score >= 83) AS n_qualified, count(*) FILTER (s.final_score >= 83) = 0 AS insufficient
FROM (SELECT DISTINCT run_id FROM videos) r LEFT JOIN scores s USING (run_id) GROUP BY r.run_id""",
)
def run_status(spark: SparkSession, d: str) -> DataFrame:
    s = stages_of(spark, d)
    return R.run_status(s.resolved.select("run_id").distinct(), s.scores)


@query(
    "video_evidence",
    BASE + """SELECT run_id, artist_id, sha256(string_agg(video_id, ',' ORDER BY video_id)) AS accepted,
  coalesce(string_agg(CASE WHEN views IS NULL THEN video_id || ':views_null' WHEN views = 0 THEN video_id || ':views_null_or_zero' END, ',' ORDER BY video_id), '') AS rejected FROM rated GROUP BY ALL""",
)
def video_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Accepted ids by a digest that they stream through, and what was rejected as the text that the query asks for."""
    m = stages_of(spark, d).measured
    accepted = exact.hashed(m.select("run_id", "artist_id", "video_id").repartition("run_id", "artist_id").sortWithinPartitions("run_id", "artist_id", "video_id"), ["run_id", "artist_id"], lambda _: ("", ""), lambda r: r["video_id"], plain_text=True)
    rejected = m.withColumn("reason", SC.rejected_for()).where("reason IS NOT NULL").groupBy("run_id", "artist_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "video_id", "reason"))), ",").alias("rejected"))
    return accepted.select("run_id", "artist_id", F.col("digest").alias("accepted")).join(rejected, ["run_id", "artist_id"], "left").select("run_id", "artist_id", "accepted", F.coalesce("rejected", F.lit("")).alias("rejected"))


@query(
    "score_scalars",
    """SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'Low' WHEN p_size <= 15 THEN 'Medium' ELSE 'High' END AS base_level,
  CASE WHEN p_retailprice >= 1000 THEN round(p_retailprice::DECIMAL(30, 10) / 1000, 1)::DECIMAL(20, 1) || 'k/day' ELSE round(p_retailprice::DECIMAL(30, 10), 0)::DECIMAL(20, 0) || '/day' END AS shown_velocity,
  floor(round(p_retailprice / 20, 10) + 0.5)::INTEGER AS score, CASE WHEN floor(round(p_retailprice / 20, 10) + 0.5) >= 83 THEN floor(round(p_retailprice / 20, 10) + 0.5)::INTEGER || '/100' END AS shown_score,
  round(CASE WHEN p_size % 7 > 0 THEN (p_size - p_size % 7) / (p_size % 7) END, 8) AS growth, round(least(1.0, ln(1 + p_size) / ln(21)), 8) AS saturated,
  format('{:08x}-0000-4000-8000-{:012x}', 7, p_partkey) AS derived FROM part""",
)
def score_scalars(spark: SparkSession, d: str) -> DataFrame:
    """F12, F15-F19, F27."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    score = S.final_score(F.col("p_retailprice") / 20)
    return p.select(
        "p_partkey", S.base_competition(F.col("p_size")).alias("base_level"), S.velocity_display(F.col("p_retailprice")).alias("shown_velocity"), score.alias("score"), S.score_display(score).alias("shown_score"),
        F.round(S.growth(F.col("p_size"), F.col("p_size") % 7), 8).alias("growth"), F.round(S.ln_saturating(F.col("p_size"), 20), 8).alias("saturated"), F.expr(replay.derived_id(7, "p_partkey")).alias("derived"),
    )


# ---- event log -----------------------------------------------------------------------------------------------------



@query(
    "funnel_ratios",
    EV + """, c AS (SELECT count(DISTINCT CASE WHEN event_type = 'report_opened' THEN producer_id END) AS opened,
    count(DISTINCT CASE WHEN event_type = 'intent_to_produce_declared' THEN producer_id END) AS declared, count(*) FILTER (event_type = 'intent_to_produce_declared') AS intents,
    count(*) FILTER (event_type = 'followup_confirmed_produced') AS confirmed, count(DISTINCT CASE WHEN event_type = 'wtp_yes' THEN producer_id END) AS wtp_yes,
    count(DISTINCT CASE WHEN event_type IN ('wtp_yes', 'wtp_no') THEN producer_id END) AS wtp_any FROM ev)
SELECT *, declared / nullif(opened, 0) AS declared_intent, confirmed / nullif(intents, 0) AS followup_confirmed, wtp_yes / nullif(wtp_any, 0) AS positive_wtp, opened < 15 AS directional_only FROM c""",
)
def funnel_ratios(spark: SparkSession, d: str) -> DataFrame:
    return funnel.ratios(events_of(spark, d))


@query(
    "funnel_hot_usefulness",
    EV + """, i AS (SELECT report_id, artist_id, bool_or(event_type = 'report_opened') AS v, bool_or(event_type = 'opportunity_marked_useful') AS u FROM ev WHERE tag = 'HOT' GROUP BY ALL)
SELECT count(*) FILTER (v) AS viewed, count(*) FILTER (v AND u) AS useful, count(*) FILTER (v AND u) / nullif(count(*) FILTER (v), 0) AS hot_usefulness FROM i""",
)
def funnel_hot_usefulness(spark: SparkSession, d: str) -> DataFrame:
    return funnel.hot_usefulness(events_of(spark, d))


@query(
    "funnel_open_rate",
    EV + """, a AS (SELECT DISTINCT concat('p-', CAST(c_custkey AS STRING)) AS producer_id FROM customer)
SELECT count(*) AS approved, count(o.producer_id) AS opened, count(o.producer_id) / nullif(count(*), 0) AS open_rate
FROM a LEFT JOIN (SELECT DISTINCT producer_id FROM ev WHERE event_type = 'report_opened') o USING (producer_id)""",
)
def funnel_open_rate(spark: SparkSession, d: str) -> DataFrame:
    return funnel.open_rate(A.relation(spark, d, "SELECT concat('p-', CAST(c_custkey AS STRING)) AS producer_id FROM {customer}"), events_of(spark, d))


FIRST = "SELECT producer_id, artist_id, report_id, event_id, created_at FROM ev WHERE event_type = 'intent_to_produce_declared' QUALIFY row_number() OVER (PARTITION BY producer_id, artist_id, report_id ORDER BY created_at, event_id) = 1"


@query("funnel_first_intents", EV + FIRST)
def funnel_first_intents(spark: SparkSession, d: str) -> DataFrame:
    return funnel.first_intents(events_of(spark, d))


#: Some follow-ups were sent or answered already.
FOLLOWUP = "CASE event_id % 4 WHEN 1 THEN 'sent' WHEN 2 THEN 'responded' ELSE 'pending' END"


@query("funnel_due_followups", EV + f", f AS ({FIRST}) SELECT *, created_at + INTERVAL 10 DAY AS due_at, 'pending' AS status FROM f WHERE created_at + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20 00:00:00' AND event_id % 4 NOT IN (1, 2)")
def funnel_due_followups(spark: SparkSession, d: str) -> DataFrame:
    f = funnel.scheduled_followups(funnel.first_intents(events_of(spark, d)))
    return funnel.due_followups(f.withColumn("status", F.expr(FOLLOWUP)), "2024-01-20 00:00:00")


@query("funnel_latest_wtp", EV + "SELECT producer_id, event_id, event_type = 'wtp_yes' AS would_pay FROM ev WHERE event_type IN ('wtp_yes', 'wtp_no') QUALIFY row_number() OVER (PARTITION BY producer_id ORDER BY created_at DESC, event_id DESC) = 1")
def funnel_latest_wtp(spark: SparkSession, d: str) -> DataFrame:
    return funnel.latest_wtp(events_of(spark, d))


@query(
    "funnel_advance",
    EV + """, c AS (SELECT count(DISTINCT CASE WHEN event_type = 'report_opened' THEN producer_id END) AS opened,
    count(DISTINCT CASE WHEN event_type = 'intent_to_produce_declared' THEN producer_id END) AS declared, count(*) FILTER (event_type = 'intent_to_produce_declared') AS intents,
    count(*) FILTER (event_type = 'followup_confirmed_produced') AS confirmed, count(DISTINCT CASE WHEN event_type = 'wtp_yes' THEN producer_id END) AS yes,
    count(DISTINCT CASE WHEN event_type IN ('wtp_yes', 'wtp_no') THEN producer_id END) AS asked FROM ev)
SELECT opened, opened >= 15 AND coalesce(declared / nullif(opened, 0) >= 0.3, false) AND coalesce(confirmed / nullif(intents, 0) >= 0.5, false) AND coalesce(yes / nullif(asked, 0) >= 0.25, false) AS advance FROM c""",
)
def funnel_advance(spark: SparkSession, d: str) -> DataFrame:
    return funnel.advance(events_of(spark, d))


# ---- raw layer -----------------------------------------------------------------------------------------------------

PAGES = """
SELECT CAST(conv_id AS STRING) AS run_id, CAST(turn AS INT) AS page, CASE WHEN turn > 0 THEN concat('t', CAST(turn AS STRING)) END AS page_token,
  concat('t', CAST(turn + 1 AS STRING)) AS next_token FROM {conversations}
"""
ITEMS = """
SELECT concat('run-', CAST(o_custkey % 40 AS STRING)) AS run_id, CAST(l_linenumber AS INT) AS page, CAST(l_suppkey % 50 AS INT) AS item, concat('v', CAST(l_partkey AS STRING)) AS video_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
CHARGES = "SELECT concat('q-', CAST(user_id % 40 AS STRING)) AS run_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 100 ELSE 1 END AS units, event_type = 'error' AS is_retry FROM {events}"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return A.relation(spark, d, ITEMS)


FIRST_IDS = f"""WITH i AS ({A.duck(ITEMS)}), f AS (SELECT run_id, video_id, min(page * 1000 + item) AS place FROM i GROUP BY ALL),
r AS (SELECT run_id, video_id, row_number() OVER (PARTITION BY run_id ORDER BY place, video_id)::INTEGER AS position FROM f), u AS (SELECT * FROM r WHERE position <= 500) """


@query("first_unique_ids", FIRST_IDS + "SELECT run_id, video_id, position, ceil(position / 50)::INTEGER AS batch FROM u")
def first_unique_ids(spark: SparkSession, d: str) -> DataFrame:
    return raw.batches(raw.first_unique(_items(spark, d)))


@query(
    "token_chain",
    f"""WITH RECURSIVE p AS ({A.duck(PAGES)}), w AS (SELECT run_id, page_token, next_token, 1 AS step FROM p WHERE page_token IS NULL
  UNION ALL SELECT p.run_id, p.page_token, p.next_token, w.step + 1 FROM w JOIN p ON p.run_id = w.run_id AND p.page_token = w.next_token WHERE w.step < 100)
SELECT run_id, page_token, step FROM w""",
)
def token_chain(spark: SparkSession, d: str) -> DataFrame:
    return raw.token_chain(spark, A.relation(spark, d, PAGES), raw.PAGE_CEILING)


@query(
    "quota_ledger",
    f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM ({A.duck(CHARGES)}) AS a),
w AS (
  SELECT DISTINCT run_id, NULL::BIGINT AS seq, 0 AS units, false AS is_retry, 0::BIGINT AS n, 0::BIGINT AS total, 0::BIGINT AS surplus, false AS accepted FROM c
  UNION ALL
  SELECT c.run_id, c.seq, c.units, c.is_retry, c.n, w.total + CASE WHEN w.total + c.units <= 2000 AND (NOT c.is_retry OR w.surplus + c.units <= 500) THEN c.units ELSE 0 END,
    w.surplus + CASE WHEN c.is_retry AND w.total + c.units <= 2000 AND w.surplus + c.units <= 500 THEN c.units ELSE 0 END,
    w.total + c.units <= 2000 AND (NOT c.is_retry OR w.surplus + c.units <= 500)
  FROM w JOIN c ON c.run_id = w.run_id AND c.n = w.n + 1)
SELECT run_id, seq, units, is_retry, total, surplus, accepted FROM w WHERE n > 0""",
)
def quota_ledger(spark: SparkSession, d: str) -> DataFrame:
    return raw.quota_ledger(A.relation(spark, d, CHARGES))


@query(
    "run_states",
    """SELECT CAST(o_custkey AS STRING) AS run_id, CASE WHEN max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) = 3 THEN 'failed'
  WHEN max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) = 2 THEN 'finalized' ELSE 'collecting' END AS state FROM orders GROUP BY o_custkey""",
)
def run_states(spark: SparkSession, d: str) -> DataFrame:
    return raw.run_states(A.relation(spark, d, "SELECT CAST(o_custkey AS STRING) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'finalized' ELSE 'collecting' END AS mark FROM {orders}"))




@query("project_videos", f"WITH v AS ({A.duck(A.VIDEOS)}) SELECT run_id, video_id, channel_id, source_title, views, likes, comments, published_at FROM v")
def project_videos(spark: SparkSession, d: str) -> DataFrame:
    """P1 and P3 on bodies made of the videos: what was null is an absent key."""
    return raw.project_videos(videos_of(spark, d).select("run_id", video_body().alias("body")))


def video_body() -> Column:
    """A body as it is landed, made of a video's columns."""
    text = lambda c: F.col(c).cast("string")
    return F.to_json(
        F.struct(
            F.lit(raw.VIDEO_KIND).alias("kind"), F.col("video_id").alias("id"), F.struct(F.col("channel_id").alias("channelId"), F.col("source_title").alias("title"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"),
            F.struct(text("views").alias("viewCount"), text("likes").alias("likeCount"), text("comments").alias("commentCount")).alias("statistics"),
        )
    )


@query("project_channels", f"WITH c AS ({A.duck(A.CHANNELS)}) SELECT channel_id, title, subscriber_count, NULL::BIGINT AS view_count, 0::BIGINT AS upload_count FROM c")
def project_channels(spark: SparkSession, d: str) -> DataFrame:
    c = A.relation(spark, d, A.CHANNELS)
    body = F.to_json(F.struct(F.lit(raw.CHANNEL_KIND).alias("kind"), F.col("channel_id").alias("id"), F.struct("title").alias("snippet"), F.struct(F.lit("0").alias("videoCount"), F.col("subscriber_count").cast("string").alias("subscriberCount")).alias("statistics")))
    return raw.project_channels(c.select(body.alias("body")))


@query(
    "page_items",
    f"WITH i AS ({A.duck(ITEMS)}), p AS (SELECT run_id, page, list(video_id ORDER BY item, video_id) AS ids FROM i GROUP BY ALL) SELECT run_id, page, unnest(range(len(ids)))::INTEGER AS item, unnest(ids) AS video_id FROM p",
)
def page_items(spark: SparkSession, d: str) -> DataFrame:
    """J11 on page bodies made of the items."""
    entry = F.struct(F.col("item"), F.col("video_id"))
    pages = _items(spark, d).groupBy("run_id", "page").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    body = F.to_json(F.struct(F.lit("page").alias("kind"), F.transform("all", lambda x: F.struct(F.struct(x["video_id"].alias("videoId")).alias("id"))).alias("items")))
    return raw.page_items(pages.select("run_id", "page", body.alias("body")))


@query("transport_keys", "SELECT event_id, event_id % 7 = 0 AS carries FROM events")
def transport_keys(spark: SparkSession, d: str) -> DataFrame:
    """P4."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit('{"id": "x", "headers": {}}')).when(F.col("event_id") % 7 == 1, F.lit('{"id": "key", "items": [{"key": 1}]}')).otherwise(F.lit('{"id": 1}')).alias("body"))
    return e.select("event_id", raw.carries_transport(F.col("body")).alias("carries"))


@query("new_rows", "SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey < 2")
def new_rows(spark: SparkSession, d: str) -> DataFrame:
    """S8, R7."""
    nation = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey < 2").select(F.col("n_nationkey").alias("k"))
    return raw.new_rows(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("k")), nation, ["k"])


RETURNED = "SELECT concat('v', CAST(CASE WHEN l_partkey % 5 = 0 THEN -l_suppkey ELSE l_partkey END AS STRING)) AS video_id FROM {lineitem}"


@query(
    "returned_ids",
    f"""WITH q AS (SELECT DISTINCT 'v' || p_partkey AS video_id FROM part), r AS (SELECT video_id, count(*) AS n FROM ({A.duck(RETURNED)}) AS a GROUP BY 1)
SELECT coalesce(q.video_id, r.video_id) AS video_id, CASE WHEN n IS NULL THEN 'missing' WHEN q.video_id IS NULL THEN 'extra' ELSE 'duplicate' END AS fault FROM q FULL JOIN r USING (video_id) WHERE n IS NULL OR q.video_id IS NULL OR n > 1""",
)
def returned_ids(spark: SparkSession, d: str) -> DataFrame:
    """U4: some of the ids that come back are others than those asked for."""
    asked = A.relation(spark, d, "SELECT DISTINCT concat('v', CAST(p_partkey AS STRING)) AS video_id FROM {part}")
    return raw.returned_ids(asked, A.relation(spark, d, RETURNED))


#: Shapes of a model's reply; @ stands for the field with a part's name.
REPLIES = (
    "{@}", '{"candidate": null}', '{"candidate": 5}', '{"candidate": "a", "x": 1}', "not json", "{@} trailing", '{@}{"a":1}', "{'candidate':'x'}", " \n{@}\t", "[{@}]", "{@}] {", "{@,@}", '{"candidate":["x"]}',
)


@query(
    "model_replies",
    f"""SELECT part.p_partkey, CASE WHEN p_partkey % {len(REPLIES)} IN (0, 8) THEN p_name END AS candidate, CASE WHEN p_partkey % {len(REPLIES)} NOT IN (0, 1, 8) THEN 'llm_contract_violation' END AS error FROM part""",
)
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """replies that hold a part's name, among them some with more before or after the object, other quotes and a repeated field."""
    p = spark.read.parquet(f"{d}/part.parquet")
    listed = F.to_json(F.array("p_name"))
    pair = F.concat(F.lit('"candidate": '), F.substr(listed, F.lit(2), F.length(listed) - 2))
    shapes = [F.replace(F.lit(shape), F.lit("@"), pair) for shape in REPLIES]
    reply = F.element_at(F.array(*shapes), (F.col("p_partkey") % len(REPLIES) + 1).cast("int"))
    candidate, error = N.parse_reply(F.col("reply"))
    return p.select("p_partkey", reply.alias("reply")).select("p_partkey", candidate.alias("candidate"), error.alias("error"))


# ---- gates: each query gives the rows that break a rule -------------------------------------------------------------


@query("gate_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) <> 1")
def gate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return gates.duplicates(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("gate_nulls", f"WITH v AS ({A.duck(A.VIDEOS)}) SELECT video_id FROM v WHERE views IS NULL OR likes IS NULL")
def gate_nulls(spark: SparkSession, d: str) -> DataFrame:
    return gates.nulls(videos_of(spark, d), ["views", "likes"]).select("video_id")


@query("gate_blanks", f"WITH v AS ({A.duck(A.VIDEOS)}) SELECT video_id FROM v WHERE coalesce(trim(source_title), '') = ''")
def gate_blanks(spark: SparkSession, d: str) -> DataFrame:
    return gates.blanks(videos_of(spark, d), ["source_title"]).select("video_id")


@query(
    "gate_set_difference",
    """(SELECT c_custkey AS k, 'left' AS side FROM customer EXCEPT SELECT CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE -o_custkey END, 'left' FROM orders)
UNION ALL (SELECT CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE -o_custkey END, 'right' FROM orders EXCEPT SELECT c_custkey, 'right' FROM customer)""",
)
def gate_set_difference(spark: SparkSession, d: str) -> DataFrame:
    rich = A.relation(spark, d, "SELECT CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE -o_custkey END AS k FROM {orders}")
    return gates.set_difference(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k")), rich, ["k"])


@query("gate_orphans", "SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey NOT IN (SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey END FROM supplier)")
def gate_orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = A.relation(spark, d, "SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey END AS k FROM {supplier}")
    return gates.orphans(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("k")), parents, ["k"])


@query("gate_missing_channels", BASE + "SELECT DISTINCT run_id, channel_id FROM mapped WHERE channel_id NOT IN (SELECT channel_id FROM channels WHERE subscriber_count IS NOT NULL)")
def gate_missing_channels(spark: SparkSession, d: str) -> DataFrame:
    s = stages_of(spark, d)
    return C.missing_records(s.mapped, s.relations.channels.where("subscriber_count IS NOT NULL")).select("run_id", "channel_id")


@query("gate_projection", f"WITH v AS ({A.duck(A.VIDEOS)}) SELECT video_id FROM v WHERE views IS DISTINCT FROM coalesce(views, 0) OR likes IS DISTINCT FROM coalesce(likes, 0)")
def gate_projection(spark: SparkSession, d: str) -> DataFrame:
    """Rows that took null for 0 are found by the bodies that they were projected from."""
    landed = videos_of(spark, d).withColumn("body", video_body())
    taken = landed.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("views", "likes")})
    paths = {
        "video_id": ("id", "string"), "channel_id": ("snippet.channelId", "string"), "source_title": ("snippet.title", "string"),
        "views": ("statistics.viewCount", "bigint"), "likes": ("statistics.likeCount", "bigint"), "comments": ("statistics.commentCount", "bigint"),
    }
    return gates.unlike_body(taken, "body", raw.VIDEO_KIND, paths).select("video_id")


@query("gate_future", f"WITH v AS ({A.duck(A.VIDEOS)}) SELECT video_id FROM v WHERE published_at > window_end - INTERVAL 20 DAY")
def gate_future(spark: SparkSession, d: str) -> DataFrame:
    return gates.future(videos_of(spark, d).withColumn("window_end", F.expr("window_end - INTERVAL 20 DAYS"))).select("video_id")


RUNS = "SELECT o_orderkey AS run, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS keyword, o_orderstatus AS vertical, CAST(o_orderdate AS TIMESTAMP) AS window_start, CAST(o_orderdate + CASE WHEN o_orderkey % 4 = 0 THEN INTERVAL '29' DAY ELSE INTERVAL '30' DAY END AS TIMESTAMP) AS window_end FROM {orders}"


@query("gate_run_identity", "SELECT o_orderkey AS run FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 4 = 0")
def gate_run_identity(spark: SparkSession, d: str) -> DataFrame:
    return gates.run_identity(A.relation(spark, d, RUNS)).select("run")


#: The second page of every third run leads to none.
BROKEN_PAGES = """
SELECT CAST(conv_id AS STRING) AS run_id, CAST(turn AS INT) AS page, CASE WHEN turn > 0 THEN concat('t', CAST(turn AS STRING)) END AS page_token,
  concat('t', CAST(CASE WHEN turn = 1 AND conv_id % 3 = 0 THEN -1 ELSE turn + 1 END AS STRING)) AS next_token FROM {conversations}
"""


@query(
    "gate_unvisited_pages",
    f"""WITH RECURSIVE p AS ({A.duck(BROKEN_PAGES)}), w AS (SELECT run_id, page_token, next_token, 1 AS step FROM p WHERE page_token IS NULL
  UNION ALL SELECT p.run_id, p.page_token, p.next_token, w.step + 1 FROM w JOIN p ON p.run_id = w.run_id AND p.page_token = w.next_token WHERE w.step < 100)
SELECT run_id, page_token FROM p WHERE (run_id, coalesce(page_token, '')) NOT IN (SELECT run_id, coalesce(page_token, '') FROM w)""",
)
def gate_unvisited_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = A.relation(spark, d, BROKEN_PAGES)
    return gates.unvisited_pages(pages, raw.token_chain(spark, pages, raw.PAGE_CEILING))


@query(
    "gate_dangling_tokens",
    f"""WITH p AS ({A.duck(PAGES)}) SELECT run_id, next_token AS page_token FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.run_id = a.run_id AND b.page_token = a.next_token) AND run_id::BIGINT % 3 <> 0""",
)
def gate_dangling_tokens(spark: SparkSession, d: str) -> DataFrame:
    pages = A.relation(spark, d, PAGES)
    full = pages.where("CAST(run_id AS BIGINT) % 3 = 0").select("run_id", F.lit("v").alias("video_id"))
    return gates.dangling_tokens(pages, full, target=1)


@query(
    "gate_unfinished",
    """WITH r AS (SELECT o_custkey AS run_id, CASE WHEN o_custkey % 6 = 0 THEN 'failed' ELSE 'finalized' END AS status, count(*) + (o_custkey % 5 = 0)::INT AS video_count FROM orders GROUP BY o_custkey),
n AS (SELECT o_custkey AS run_id, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
SELECT run_id, status, video_count, n FROM r JOIN n USING (run_id) WHERE status = 'failed' OR video_count <> n OR video_count > 500""",
)
def gate_unfinished(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    runs = o.groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("c")).select("run_id", F.when(F.col("run_id") % 6 == 0, "failed").otherwise("finalized").alias("status"), (F.col("c") + (F.col("run_id") % 5 == 0).cast("int")).alias("video_count"))
    return gates.unfinished(runs, o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("video_id")))


@query("gate_several_values", "SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def gate_several_values(spark: SparkSession, d: str) -> DataFrame:
    return gates.several_values(spark.read.parquet(f"{d}/part.parquet"), ["p_brand"], ["p_type"])


@query("gate_evidence", "SELECT p_partkey FROM part WHERE p_size % 4 <> 0")
def gate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of four shapes only the first is whole."""
    shapes = ['{"components":[1],"tiebreak":{},"selected_example":{"video_id":"v"}}', '{"components":[],"tiebreak":{},"selected_example":{"video_id":"v"}}', '{"components":[1],"selected_example":{"video_id":"v"}}', '{"components":[1],"tiebreak":{},"selected_example":{"video_id":" "}}']
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("json", F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_size") % 4 + 1).cast("int")))
    return gates.bad_evidence(p, "json", {"components": "array", "tiebreak": "object", "selected_example.video_id": "text"}).select("p_partkey")


@query("gate_transitions", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 IN (3, 4)")
def gate_transitions(spark: SparkSession, d: str) -> DataFrame:
    """A draft, publishing and archiving are allowed; going back and starting published aren't."""
    k = F.col("o_orderkey") % 5
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(k == 1, "draft").when(k == 2, "published").when(k == 3, "archived").alias("old"), F.when(k == 0, "draft").when(k == 1, "published").when(k == 2, "archived").otherwise("published").alias("new"))
    return gates.bad_transitions(o, gates.REPORT_STATES).select("o_orderkey")


@query("gate_locked_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))")
def gate_locked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders are reports, and their customers' numbers what they refer to."""
    reports = A.relation(spark, d, "SELECT o_orderkey AS report_id, CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'P' THEN 'archived' ELSE 'draft' END AS status FROM {orders}")
    items = A.relation(spark, d, "SELECT o_orderkey AS report_id, o_custkey AS l_partkey FROM {orders}")
    return gates.locked_by_reports(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey"), items, reports, ["l_partkey"])


# ---- replay ----------------------------------------------------------------------------------------------------------


@query("set_digests", "SELECT l_suppkey, sha256('[' || string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) || ']') AS digest FROM (SELECT l_suppkey, '\"' || l_partkey || '\"' AS l_partkey FROM lineitem) GROUP BY l_suppkey")
def set_digests(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.col("l_partkey").cast("string").alias("p"))
    return replay.set_digest(rows, ["l_suppkey"], "p")


EVIDENCE = """
SELECT CAST(o_custkey AS STRING) AS session_id, CAST(1 + o_orderkey % 2 AS INT) AS round, concat('r', CAST((o_orderkey - o_orderkey % 2) % 4 AS STRING)) AS report_id,
  CAST(CASE WHEN o_custkey % 3 = 0 OR o_orderpriority = '1-URGENT' THEN o_orderkey ELSE o_custkey END AS STRING) AS digest FROM {orders}
"""
ONE_EACH = "SELECT session_id, round, report_id, min(digest) AS digest FROM ({e}) AS e GROUP BY session_id, round, report_id"
PAIRS = f"""WITH e AS ({ONE_EACH.format(e=A.duck(EVIDENCE))}), pairs AS (
  SELECT coalesce(a.session_id, b.session_id) AS session_id, a.digest AS d1, b.digest AS d2 FROM (SELECT * FROM e WHERE round = 1) a
  FULL JOIN (SELECT * FROM e WHERE round = 2) b ON a.session_id = b.session_id AND a.report_id = b.report_id),
cmp AS (SELECT session_id, count(*) FILTER (d1 IS NOT NULL AND d2 IS NOT NULL) AS pairs, count(*) FILTER (d1 IS DISTINCT FROM d2) AS mismatches FROM pairs GROUP BY 1)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return A.relation(spark, d, EVIDENCE).groupBy("session_id", "round", "report_id").agg(F.min("digest").alias("digest"))


@query("compare_rounds", PAIRS + " SELECT * FROM cmp")
def compare_rounds(spark: SparkSession, d: str) -> DataFrame:
    return replay.compare_rounds(_evidence(spark, d))


@query(
    "pass_gate",
    PAIRS + """, ev AS (SELECT session_id, count(*) FILTER (round = 1) AS e1, count(*) FILTER (round = 2) AS e2, count(DISTINCT report_id) AS reports FROM e GROUP BY 1),
t AS (SELECT ev.*, pairs, mismatches, ev.session_id::BIGINT AS k FROM ev JOIN cmp USING (session_id)),
bad AS (SELECT session_id, unnest([CASE WHEN k % 7 = 0 THEN 'contract' END, CASE WHEN reports <> 2 THEN 'two_reports' END, CASE WHEN k % 5 = 0 THEN 'same_manifest' END, CASE WHEN e1 <> 2 OR e2 <> 2 THEN 'evidence' END,
    CASE WHEN pairs <> 2 THEN 'pairs' END, CASE WHEN mismatches <> 0 THEN 'no_mismatch' END]) AS violation FROM t)
SELECT * FROM bad WHERE violation IS NOT NULL""",
)
def pass_gate(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d)
    k = F.col("session_id").cast("long")
    sessions = e.select("session_id").distinct().select("session_id", F.when(k % 7 == 0, "other").otherwise(COMPARISON_CONTRACT).alias("contract"))
    rounds = sessions.select("session_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("round")).select(
        "session_id", "round", F.lit("s").alias("source_run_id"), F.lit("h").alias("snapshot_hash"), F.lit("v").alias("engine_version"), F.sha2(F.when(k % 5 == 0, F.col("round").cast("string")).otherwise("m"), 256).alias("manifest_hash")
    )
    return replay.pass_gate(sessions, rounds, e)


FACTS = "SELECT event_id AS fact_id, concat('r', CAST(user_id % 7 AS STRING)) AS run_id, CAST(user_id AS STRING) AS video_id, CASE WHEN event_type = 'error' THEN 'old' ELSE 'new' END AS resolver_version, event_type AS reason_code, CAST(ts AS TIMESTAMP) AS created_at FROM {events}"


@query("latest_facts", f"SELECT * FROM ({A.duck(FACTS)}) AS f WHERE resolver_version = 'new' QUALIFY row_number() OVER (PARTITION BY run_id, video_id ORDER BY created_at DESC, fact_id DESC) = 1")
def latest_facts(spark: SparkSession, d: str) -> DataFrame:
    return replay.latest_facts(A.relation(spark, d, FACTS), "new")


@query("missing_facts", BASE + "SELECT run_id, video_id FROM tried WHERE rule_reason <> 'source_title_missing' AND rule_reason <> 'regex_autoaccepted'")
def missing_facts(spark: SparkSession, d: str) -> DataFrame:
    """Videos with a title for which only accepted outcomes are facts."""
    o = stages_of(spark, d).outcomes
    return replay.missing_facts(o.where("rule_reason <> 'source_title_missing'"), o.where("decision = 'accepted'"))


@query(
    "reviewed_outcomes",
    BASE + """SELECT run_id, video_id, 'human_override' AS method, CASE WHEN right(video_id, 1) IN ('0', '2', '4', '6', '8') THEN 'accepted' ELSE 'rejected' END AS decision,
  CASE WHEN right(video_id, 1) IN ('0', '2', '4', '6', '8') THEN 'human_approved' ELSE 'human_rejected' END AS reason_code,
  CASE WHEN right(video_id, 1) IN ('0', '2', '4', '6', '8') THEN 'artist-11' END AS artist_id FROM tried WHERE rule_reason = 'artist_alias_collision'""",
)
def reviewed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """People approve every second of the titles whose alias collides."""
    waiting = stages_of(spark, d).outcomes.where("rule_reason = 'artist_alias_collision'")
    yes = F.substring("video_id", -1, 1).isin("0", "2", "4", "6", "8")
    people = waiting.select("run_id", "video_id", yes.alias("approved"), F.when(yes, "artist-11").alias("artist_id"))
    return replay.apply_review(waiting, people).select("run_id", "video_id", "method", "decision", "reason_code", "artist_id")


@query(
    "replayed_outcomes",
    BASE + """SELECT run_id, video_id, CASE WHEN rule_reason = 'artist_alias_collision' THEN 'accepted' WHEN rule_reason = 'regex_autoaccepted' THEN 'accepted' WHEN rule_reason IN ('source_title_missing', 'candidate_outside_source_title') THEN 'rejected' ELSE 'review_required' END AS decision,
  CASE WHEN rule_reason = 'artist_alias_collision' THEN 'artist-11' WHEN rule_reason = 'regex_autoaccepted' AND len(ids) = 1 THEN ids[1] END AS artist_id, rule_reason = 'artist_alias_collision' AS replayed FROM tried""",
)
def replayed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The second round finds the reviews as facts."""
    r = relations(spark, d)
    first = N.resolve(r.videos, r.names, normalize=X.normalize_ascii).where("rule_reason = 'artist_alias_collision'")
    facts = replay.apply_review(first, first.select("run_id", "video_id", F.lit(True).alias("approved"), F.lit("artist-11").alias("artist_id")))
    return N.resolve(r.videos, r.names, facts=facts, normalize=X.normalize_ascii).select("run_id", "video_id", "decision", "artist_id", "replayed")


SPENT = "SELECT CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_type = 'view' THEN 100 ELSE 1 END AS units FROM {events}"


@query(
    "quota_alerts",
    """WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, CASE WHEN event_type = 'view' THEN 100 ELSE 1 END AS units FROM events) SELECT h AS window_start, sum(units)::BIGINT AS units FROM c GROUP BY h HAVING sum(units) >= 150""",
)
def quota_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming alert, on hours."""
    return quota.alerts(A.relation(spark, d, SPENT), window="1 hour", slide=None, at_least=150).select(F.col("window.start").alias("window_start"), "units")


@query(
    "quota_alerts_rolling",
    """WITH c AS (SELECT date_trunc('minute', ts) - to_minutes(unnest(range(30))) AS w, CASE WHEN event_type = 'view' THEN 100 ELSE 1 END AS units FROM events)
SELECT w AS window_start, w + INTERVAL 30 MINUTE AS window_end, sum(units)::BIGINT AS units FROM c GROUP BY w HAVING sum(units) >= 200""",
)
def quota_alerts_rolling(spark: SparkSession, d: str) -> DataFrame:
    """The alert as it is meant: 30 minutes, looked at every minute; the bar is one that these charges reach."""
    return quota.alerts(A.relation(spark, d, SPENT), at_least=200).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "units")


# ---- further operators ------------------------------------------------------------------------------------------------

BRAND = "regexp_extract(source_title, '^Brand#[0-9]+', 0)"


@query(
    "pending_reuse",
    BASE + f"""SELECT run_id, video_id, 'llm_assisted' AS method, {BRAND} AS candidate, 'review_required' AS decision,
  CASE WHEN views IS NULL THEN 'pending_resolver_version_conflict' ELSE 'pending_candidate_reused' END AS reason_code, true AS needs_review, true AS replayed
FROM tried WHERE rule_reason = 'regex_multiple_artists' AND {BRAND} <> ''""",
)
def pending_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Titles with several names wait for a review already, some of them of an older resolver."""
    r = relations(spark, d)
    tried = N.attempts(r.videos, N.judge_titles(r.videos, N.name_index(r.names, X.normalize_ascii), X.normalize_ascii)).where("rule_reason = 'regex_multiple_artists'")
    waiting = tried.select("run_id", "video_id", F.expr(BRAND).alias("proposed_name"), F.lit("llm_assisted").alias("method"), F.when(F.col("views").isNull(), "older").otherwise(RESOLVER_VERSION).alias("resolver_version")).where("proposed_name <> ''")
    found = plan.stages(r, pending=waiting, normalize=X.normalize_ascii).outcomes.where("replayed")
    return found.select("run_id", "video_id", "method", "candidate", "decision", "reason_code", "needs_review", "replayed")


@query(
    "model_candidates",
    BASE + f""", o AS (SELECT *, CASE WHEN {BRAND} <> '' THEN 1 WHEN source_title LIKE '[FREE]%' THEN 2 ELSE 3 END AS kind FROM tried
  WHERE rule_reason NOT IN ('regex_autoaccepted', 'candidate_outside_source_title', 'source_title_missing'))
SELECT run_id, video_id, CASE WHEN kind = 1 THEN {BRAND} END AS candidate, CASE WHEN kind = 1 THEN 'review_required' ELSE 'rejected' END AS decision,
  CASE kind WHEN 1 THEN rule_reason || ':llm_candidate_pending' WHEN 2 THEN 'llm_no_single_candidate' ELSE 'llm_call_failed' END AS reason_code, kind = 1 AS needs_review FROM o""",
)
def model_candidates(spark: SparkSession, d: str) -> DataFrame:
    """C4: a made-up model names the brand that a title begins with, finds none in some titles, and fails on others."""

    def model(title: Column) -> Column:
        brand = F.regexp_extract(title, "^Brand#[0-9]+", 0)
        return F.when(brand != "", F.to_json(F.struct(brand.alias("candidate")))).when(title.startswith("[FREE]"), '{"candidate": null}')

    found = plan.stages(relations(spark, d), normalize=X.normalize_ascii, extract=model).outcomes.where("method = 'llm_assisted'")
    return found.select("run_id", "video_id", "candidate", "decision", "reason_code", "needs_review")


@query("exact_scores", BASE + "SELECT run_id, rank, artist_id, final_score FROM ranked")
def exact_scores(spark: SparkSession, d: str) -> DataFrame:
    """The digest tier's scores and ranks, of 50-digit decimals."""
    s = stages_of(spark, d)
    return exact.scores(exact.figures(exact.timed(s.eligible.drop("window_end"), s.relations.runs))).select("run_id", "rank", "artist_id", "final_score")


@query("gate_session_transitions", "SELECT o_orderkey FROM orders WHERE NOT ((o_custkey % 7 = o_orderkey % 6 + 1 AND o_custkey % 7 < 6) OR (o_custkey % 7 = 6 AND o_orderkey % 6 < 5))")
def gate_session_transitions(spark: SparkSession, d: str) -> DataFrame:
    """C11."""
    states = F.array(*map(F.lit, (*gates.SESSION_STATES, "failed")))
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", states[(F.col("o_orderkey") % 6).cast("int")].alias("old"), states[(F.col("o_custkey") % 7).cast("int")].alias("new"))
    return gates.bad_transitions(o, gates.session_transitions()).select("o_orderkey")


@query(
    "gate_handshake",
    """WITH a AS (SELECT l_orderkey, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN -1 ELSE l_partkey END AS p, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS l, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS r FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.p = b.p)
SELECT l_orderkey, sum(l)::BIGINT AS only_left, sum(r)::BIGINT AS only_right FROM c GROUP BY 1 HAVING sum(l) > 0 OR sum(r) > 0""",
)
def gate_handshake(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one stage against those of the next, some of which became others."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"))
    changed = rows.withColumn("p", F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 5 == 0), F.lit(-1)).otherwise(F.col("p")))
    return gates.handshake(rows, changed, ["l_orderkey"], "p")


@query(
    "structural_digests",
    """WITH d AS (SELECT l_suppkey, sha256(l_orderkey::VARCHAR || chr(31) || l_linenumber::VARCHAR || chr(31) || coalesce(l_returnflag, chr(0))) AS d FROM lineitem),
s AS (SELECT l_suppkey, count(*) AS n, sum(('0x' || substr(d, 1, 12))::BIGINT) AS a, sum(('0x' || substr(d, 13, 12))::BIGINT) AS b, sum(('0x' || substr(d, 25, 12))::BIGINT) AS c, sum(('0x' || substr(d, 37, 12))::BIGINT) AS e FROM d GROUP BY 1)
SELECT l_suppkey, n, sha256(n::VARCHAR || ':' || a::VARCHAR || ':' || b::VARCHAR || ':' || c::VARCHAR || ':' || e::VARCHAR) AS digest FROM s""",
)
def structural_digests(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return replay.row_digests(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_returnflag"])


# The identities that configurations must have.
@query(
    "config_hashes",
    """SELECT * FROM (VALUES ('rule', 'channel-filter-v1', '7a1e3c76c4bd6b666939f0b1c84e257ea77e9d05c26dcfd2164e2f74cedeaea7'),
  ('rubric', 'score_rubric_2026_06_v1', 'f0c465fbf790d1ca445e62ca13b58312bdb31c1b99a3caaf7b0be3eef083ca54'),
  ('opportunity', 'opportunity-rules-2026_06_v1', 'ce7c7c1ad5d400ff6dcf9822e436db0def9cde75ffa555568acc0219b1fba52f')) AS t(name, version, hash)""",
)
def config_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 over canonical JSON."""
    parts = {"rule": FilterRule(), "rubric": Rubric(), "opportunity": ReportRules()}
    return spark.createDataFrame([(n, c.version, c.hash) for n, c in parts.items()], "name string, version string, hash string")


@query("admins", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def admins(spark: SparkSession, d: str) -> DataFrame:
    """Some rights are revoked."""
    rights = A.relation(spark, d, "SELECT s_suppkey AS user_id, CASE WHEN s_acctbal > 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS revoked_at FROM {supplier}")
    return gates.is_admin(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id")), rights)


@query("run_windows", "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%dT%H:%M:%SZ') AS published_after, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_before FROM orders")
def run_windows(spark: SparkSession, d: str) -> DataFrame:
    """F22, F23."""
    o = A.relation(spark, d, "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS now FROM {orders}").withColumn("w", raw.window_bounds(F.col("now")))
    return o.select("o_orderkey", raw.rfc3339(F.col("w.window_start")).alias("published_after"), raw.rfc3339(F.col("w.window_end")).alias("published_before"))


# ---- selection, canonical reports, sessions, stores, keys, locators ---------------------------------------------------------


@query(
    "velocity_percentiles",
    BASE + "SELECT run_id, quantile_cont(vel, 0.5) AS median, quantile_cont(vel, 0.9) AS p90, quantile_cont(vel, 0.001) AS low, min(vel) AS least, max(vel) AS most FROM rated GROUP BY run_id",
)
def velocity_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of all videos of a run. The bar for selection by bits is set low, so runs of either kind are among them."""
    shares = {"median": 0.5, "p90": 0.9, "low": 0.001, "least": 0.0, "most": 1.0}
    return selection.percentiles(stages_of(spark, d).measured, ["run_id"], "vel", shares, hot_rows=500)


REPORT_COLUMNS = ("artist_id", "competition_channel_count", "competition_level", "example_url", "example_video_id", "rank", "rule_applied", "run_id", "score_display", "score_value", "signals", "tag", "title", "velocity_display")


@query(
    "report_digests",
    BASE + f"""SELECT run_id, count(*) AS n, strlen(j)::BIGINT AS bytes, sha256(j) AS digest FROM (
  SELECT run_id, '[' || string_agg(to_json({{{", ".join(f"{c}: {c}" for c in REPORT_COLUMNS)}}})::VARCHAR, ',' ORDER BY rank) || ']' AS j, unnest(range(count(*)))
  FROM report GROUP BY run_id) AS t GROUP BY run_id, j""",
)
def report_digests(spark: SparkSession, d: str) -> DataFrame:
    """each run's report rows as a canonical JSON list, its bytes and its digest, written by the executors."""
    return exact.canonical_digests(plan.report(relations(spark, d), normalize=X.normalize_ascii).select(*REPORT_COLUMNS), ["run_id"], ["rank"])


@query("canonical_reports")
def canonical_reports(spark: SparkSession, d: str) -> DataFrame:
    """S11 with F20: the canonical report of every run in one pass. SQL has no 50-digit decimals; tests hold it to the golden digest and to one run at a time."""
    s = stages_of(spark, d)
    videos = exact.timed(s.eligible.drop("window_end"), s.relations.runs)
    per_artist = written(exact.figures(videos), "figures")
    return exact.canonical_reports(s.relations.runs, per_artist, exact.scores(per_artist), s.relations.artists, videos=videos)


CHUNK_SIZE = 100


@query(
    "evidence_chunks",
    BASE.replace("WITH all_videos", "WITH RECURSIVE all_videos") + f""", numbered AS (SELECT *, (row_number() OVER (PARTITION BY run_id, artist_id ORDER BY video_id) - 1) // {CHUNK_SIZE} AS chunk FROM rated),
bodies AS (SELECT run_id, artist_id, chunk::BIGINT AS chunk, count(*) AS n, min(video_id) AS first_id, max(video_id) AS last_id, '[' || string_agg(to_json({{comments: comments, likes: likes,
    rejected: CASE WHEN views IS NULL THEN 'views_null' WHEN views = 0 THEN 'views_null_or_zero' END, video_id: video_id, views: views}})::VARCHAR, ',' ORDER BY video_id) || ']' AS body FROM numbered GROUP BY ALL),
chained AS (SELECT *, sha256(body) AS chain FROM bodies WHERE chunk = 0 UNION ALL SELECT b.*, sha256(c.chain || b.body) FROM chained AS c JOIN bodies AS b ON b.run_id = c.run_id AND b.artist_id = c.artist_id AND b.chunk = c.chunk + 1)
SELECT run_id, artist_id, chunk, n, first_id, last_id, sha256(body) AS body, chain FROM chained""",
)
def evidence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A13 in numbered chunks with a chained digest; a body is shown by its digest."""
    return SC.evidence(stages_of(spark, d).measured, CHUNK_SIZE).withColumn("body", F.sha2("body", 256))


S6_ITEMS = """
SELECT concat('run-', CAST(CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 10 ELSE 10 + o_custkey % 300 END AS STRING)) AS run_id, CAST(l_orderkey % 130 AS INT) AS page,
  CAST(l_linenumber * 100 + l_suppkey % 50 AS INT) AS item, CASE WHEN l_linenumber = 7 THEN '' ELSE concat('v', CAST(l_partkey AS STRING)) END AS video_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
#: Runs' pages in order, each with a token; the token of a run's first page is null. Some runs lead back, end early, or lead nowhere.
S6_PAGES = """
SELECT run_id, page, CASE WHEN n > 1 THEN token END AS page_token,
  CASE WHEN kind = 1 AND n = 5 THEN second WHEN kind = 2 AND n = 4 THEN '' WHEN kind = 3 AND n = 3 THEN 'gone' WHEN kind = 4 AND n = 6 THEN NULL ELSE following END AS next_token
FROM (SELECT run_id, page, concat('t', CAST(page AS STRING)) AS token, row_number() OVER (PARTITION BY run_id ORDER BY page) AS n, CAST(substr(run_id, 5) AS INT) % 9 AS kind,
    lead(concat('t', CAST(page AS STRING))) OVER (PARTITION BY run_id ORDER BY page) AS following, nth_value(concat('t', CAST(page AS STRING)), 2) OVER (PARTITION BY run_id ORDER BY page) AS second
  FROM (SELECT DISTINCT run_id, page FROM (""" + S6_ITEMS + """) AS i) AS p) AS q
"""
S6_SQL = f"""WITH RECURSIVE i AS ({A.duck(S6_ITEMS)}), p AS ({A.duck(S6_PAGES)}),
w AS (SELECT run_id, page_token, next_token, page, 1 AS step FROM p WHERE page_token IS NULL
  UNION ALL SELECT p.run_id, p.page_token, p.next_token, p.page, w.step + 1 FROM w JOIN p ON p.run_id = w.run_id AND p.page_token = w.next_token WHERE w.step < 101),
v AS (SELECT *, row_number() OVER (PARTITION BY run_id, page ORDER BY step) AS visit FROM w),
f AS (SELECT run_id, video_id, min(step * 10000 + item) AS place FROM v JOIN i USING (run_id, page) WHERE visit = 1 AND video_id <> '' GROUP BY ALL),
c AS (SELECT v.*, (SELECT count(*) FROM f WHERE f.run_id = v.run_id AND f.place < (v.step + 1) * 10000) AS videos, lead(step) OVER (PARTITION BY v.run_id ORDER BY step) AS following FROM v),
r AS (SELECT *, CASE WHEN visit > 1 THEN 'token_repeated' WHEN videos >= 500 THEN 'target_reached' WHEN next_token IS NULL THEN 'source_exhausted' WHEN next_token = '' THEN 'token_blank'
    WHEN step >= 100 THEN 'page_ceiling' WHEN following IS NULL THEN 'page_missing' END AS reason FROM c),
s AS (SELECT run_id, step - (visit > 1)::INT AS pages, page_token AS stop_token, reason, least(videos, 500) AS n_videos, reason NOT IN ('target_reached', 'source_exhausted') AS refused FROM r
  WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step) = 1) """


def _stops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = A.relation(spark, d, S6_PAGES)
    items = A.relation(spark, d, S6_ITEMS).join(pages.select("run_id", "page", "page_token"), ["run_id", "page"]).select("run_id", "page_token", "item", "video_id")
    return P.stops(spark, pages, items)


@query("page_stops", S6_SQL + "SELECT * FROM s")
def page_stops(spark: SparkSession, d: str) -> DataFrame:
    """The page at which each run's walk stops, and why; or what it is refused for."""
    return _stops(spark, d)[0]


@query("collected_videos", S6_SQL + """, n AS (SELECT f.run_id, video_id, row_number() OVER (PARTITION BY f.run_id ORDER BY place, video_id) AS position FROM f JOIN s ON s.run_id = f.run_id WHERE NOT refused AND place < (s.pages + 1) * 10000)
SELECT run_id, video_id, position::INTEGER AS position FROM n WHERE position <= 500""")
def collected_videos(spark: SparkSession, d: str) -> DataFrame:
    """The videos of runs with a good stop, by their first places up to it."""
    return P.collected(*_stops(spark, d))


SESSION_LOG = """
SELECT concat('s-', CAST(o_custkey AS STRING)) AS session_id, o_orderkey AS seq,
  CASE o_orderkey % 11 WHEN 0 THEN 'session_open' WHEN 1 THEN 'r1_awaiting_review' WHEN 2 THEN 'r1_resolved' WHEN 3 THEN 'r1_snapshot_frozen' WHEN 4 THEN 'r1_computed' WHEN 5 THEN 'passed'
    WHEN 6 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'session_open' END WHEN 7 THEN 'r1_awaiting_review' ELSE 'session_open' END AS state
FROM {orders}
"""


@query(
    "session_log",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ({A.duck(SESSION_LOG)}) AS a),
steps(old, new) AS (VALUES (NULL, 'session_open'), ('session_open', 'r1_awaiting_review'), ('r1_awaiting_review', 'r1_resolved'), ('r1_resolved', 'r1_snapshot_frozen'), ('r1_snapshot_frozen', 'r1_computed'), ('r1_computed', 'passed'),
  ('session_open', 'failed'), ('r1_awaiting_review', 'failed'), ('r1_resolved', 'failed'), ('r1_snapshot_frozen', 'failed'), ('r1_computed', 'failed')),
w AS (SELECT session_id, seq, state, n, state = 'session_open' AS accepted, CASE WHEN state = 'session_open' THEN state END AS state_after FROM e WHERE n = 1
  UNION ALL SELECT e.session_id, e.seq, e.state, e.n, s.new IS NOT NULL, coalesce(s.new, w.state_after) FROM w JOIN e ON e.session_id = w.session_id AND e.n = w.n + 1
    LEFT JOIN steps AS s ON s.old IS NOT DISTINCT FROM w.state_after AND s.new = e.state)
SELECT session_id, seq, state, accepted, state_after FROM w""",
)
def session_log(spark: SparkSession, d: str) -> DataFrame:
    """Each entry of the sessions' logs, whether it counts, and the state after it."""
    return session.folded(A.relation(spark, d, SESSION_LOG))


@query("published_runs", f"WITH v AS ({A.duck(A.VIDEOS)}) SELECT run_id, video_id, channel_id, views FROM v WHERE run_id NOT LIKE '%q4'")
def published_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two writers publish most runs, a third that has some of the same is refused, and what readers see is whole."""
    rows = videos_of(spark, d).select("run_id", "video_id", "channel_id", "views")
    runs = store.RunStore(spark, shared_dir(spark))
    runs.write(rows.where("run_id LIKE '%q1'"))
    runs.write(rows.where("run_id LIKE '%q2' OR run_id LIKE '%q3'"))
    try:
        runs.write(rows.where("run_id LIKE '%q3' OR run_id LIKE '%q4'"))
    except store.RunExists:
        return runs.read().select("run_id", "video_id", "channel_id", "views")
    raise AssertionError("a run was written twice")


@query("landed_videos", f"WITH v AS ({A.duck(A.VIDEOS)}) SELECT run_id, video_id, channel_id, source_title, views, likes, comments, published_at FROM v WHERE run_id IN (SELECT DISTINCT run_id FROM v WHERE run_id LIKE '%q2')")
def landed_videos(spark: SparkSession, d: str) -> DataFrame:
    """All bodies are landed, those of some runs are read by the data source and projected."""
    folder = f"{shared_dir(spark)}/landed"
    landed.land(videos_of(spark, d).select("run_id", F.dayofmonth("published_at").alias("page"), video_body().alias("body")), folder)
    asked = sorted(r.run_id for r in videos_of(spark, d).select("run_id").distinct().where("run_id LIKE '%q2'").collect())  # a few runs
    return raw.project_videos(landed.read_landed(spark, folder).where(F.col("run_id").isin(asked)).select("run_id", "body"))


#: All keys that refer to rows of other relations; some relations lack rows.
KEYED = {
    "videos": A.VIDEOS, "channels": "SELECT concat('ch-', CAST(s_suppkey AS STRING)) AS channel_id FROM {supplier} WHERE s_acctbal > 0", "artists": A.ARTISTS,
    "runs": "SELECT DISTINCT concat('run-', CAST(year(l_shipdate) AS STRING), 'q', CAST(quarter(l_shipdate) AS STRING)) AS run_id FROM {lineitem} WHERE l_shipdate > TIMESTAMP '1993-01-01 00:00:00'",
    "orders": "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_orderpriority <> '1-URGENT'", "customers": "SELECT c_custkey, c_nationkey FROM {customer} WHERE c_acctbal > 0",
    "lines": "SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'F' WHEN l_linenumber = 1 THEN NULL ELSE 'O' END AS status FROM {lineitem}",
    "offers": "SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem} WHERE l_quantity > 5", "names": A.NAMES,
}
KEYS = [
    gates.ForeignKey("video_channel", "videos", ("channel_id",), "channels", ("channel_id",)),
    gates.ForeignKey("video_run", "videos", ("run_id",), "runs", ("run_id",)),
    gates.ForeignKey("name_artist", "names", ("artist_id",), "artists", ("artist_id",)),
    gates.ForeignKey("line_order_status", "lines", ("l_orderkey", "status"), "orders", ("o_orderkey", "o_orderstatus")),
    gates.ForeignKey("line_offer", "lines", ("l_partkey", "l_suppkey"), "offers", ("l_partkey", "l_suppkey")),
    gates.ForeignKey("order_customer", "orders", ("o_custkey",), "customers", ("c_custkey",)),
]


def _orphans_sql(k: gates.ForeignKey) -> str:
    text = lambda columns: "'[\"' || " + " || '\",\"' || ".join(f"{c}::VARCHAR" for c in columns) + " || '\"]'"
    return f"SELECT '{k.name}' AS foreign_key, {text(k.columns)} AS orphan, count(*) AS n FROM ({A.duck(KEYED[k.child])}) AS c WHERE {text(k.columns)} NOT IN (SELECT {text(k.refers_to)} FROM ({A.duck(KEYED[k.parent])}) AS p WHERE {text(k.refers_to)} IS NOT NULL) GROUP BY ALL"


@query("foreign_keys", " UNION ALL ".join(map(_orphans_sql, KEYS)))
def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """The orphans of all keys, composite ones among them, in one pass over each relation."""
    return gates.foreign_keys({name: A.relation(spark, d, sql) for name, sql in KEYED.items()}, KEYS)


#: Each document with citations before, within and after it: bare ones, enumerations, quoted ones and ones beside an anchor.
CITING = """
SELECT doc_id, concat('See docs/', lang, '.md:', CAST(doc_id % 977 AS STRING), ' and :', CAST(n_chars AS STRING), '. ', replace(text, '. ', concat('. Cf. src/', source, '.py:', CAST(doc_id % 89 AS STRING), '-', CAST(doc_id % 89 + 4 AS STRING), ', D4. ')),
  CASE doc_id % 4 WHEN 0 THEN ' lines 40, 128; 384 and 790' WHEN 1 THEN ' "as lines 7 and 9 of the text say" linhas 3' WHEN 2 THEN ' at 12:45, rows 5' ELSE '' END) AS text
FROM {documents}
"""


@query("locator_findings")
def locator_findings(spark: SparkSession, d: str) -> DataFrame:
    """F28 over whole texts. RE2 has no Unicode word ends, so SQL would tell some words apart otherwise; tests hold it to brute force."""
    return locators.findings(A.relation(spark, d, CITING))


@query(
    "stamped_verdicts",
    YEAR + f"SELECT run_id, channel_id, '{RULE_VERSION}' AS rule_version, '{FilterRule().hash}' AS rule_hash, sha256(run_id || ':' || channel_id || ':{FilterRule().hash}') AS stamp FROM verdicts",
)
def stamped_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each verdict with the identity of the configuration that made it."""
    v = stages_of(spark, d, "year_id").verdicts.select("run_id", "channel_id")
    stamp = F.sha2(F.concat_ws(":", "run_id", "channel_id", F.lit(FilterRule().hash)), 256)
    return v.select("run_id", "channel_id", F.lit(RULE_VERSION).alias("rule_version"), F.lit(FilterRule().hash).alias("rule_hash"), stamp.alias("stamp"))
