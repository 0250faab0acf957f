"""Titles to entities: a lookup by normalised name and one CASE chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.errors import OutsideTitle, refuse
from gaugeline.functions import text as X
from gaugeline.functions.strict import strict
from gaugeline.plans.config import RESOLVER_VERSION


def name_index(names: DataFrame, normalize: Callable[[Column], Column] = X.normalize) -> DataFrame:
    """Normalised name and the sorted ids that it stands for, from (artist_id, name)."""
    return names.select("artist_id", normalize(F.col("name")).alias("name")).where("name <> ''").groupBy("name").agg(F.array_sort(F.collect_set("artist_id")).alias("artist_ids"))


CANDIDATE_REASONS = ("candidate_outside_source_title", "regex_multiple_artists", "regex_metadata_residual", "artist_alias_collision", "regex_autoaccepted")


def judge_titles(titles: DataFrame, index: DataFrame, normalize: Callable[[Column], Column] = X.normalize) -> DataFrame:
    """What the rules say of each distinct title (source_title): rule_candidate, rule_reason, rule_artist_id.

    However many videos share a title, the patterns are matched once."""
    titled = titles.select("source_title").distinct().withColumn("__normal", normalize(F.col("source_title"))).withColumn("__markers", X.marker_count(F.col("source_title"))).withColumn("__found", X.candidate(F.col("source_title")))
    named = titled.withColumn("__name", normalize(F.col("__found")))
    joined = named.join(index.withColumnRenamed("name", "__index").withColumnRenamed("artist_ids", "__ids"), F.col("__name") == F.col("__index"), "left")
    found = F.col("__found")
    reason = (
        F.when(F.col("__normal") == "", "source_title_missing")
        .when(F.col("__markers") == 0, "regex_no_match")
        .when(F.col("__markers") > 1, "regex_multiple_matches")
        .when(found == "", "regex_empty_candidate")
        .when(~X.is_supported(F.col("__name"), F.col("__normal")), "candidate_outside_source_title")
        .when(X.names_several(found), "regex_multiple_artists")
        .when(X.has_metadata(found), "regex_metadata_residual")
        .when(F.size("__ids") > 1, "artist_alias_collision")
        .otherwise("regex_autoaccepted")
    )
    return joined.withColumn("rule_reason", reason).select(
        "source_title",
        F.when(F.col("rule_reason").isin(*CANDIDATE_REASONS), found).alias("rule_candidate"),
        "rule_reason",
        F.when((F.col("rule_reason") == "regex_autoaccepted") & (F.size("__ids") == 1), F.col("__ids")[0]).alias("rule_artist_id"),
    )


SPREAD = 1024


def attempts(videos: DataFrame, judged: DataFrame) -> DataFrame:
    """videos with what is said of their titles.

    A null title is missing by itself and looks nothing up: such videos take one of many keys that match nothing, so they
    don't meet in one task. A title that many videos share is split by the engine's skew handling, as this is one plain
    equi-join. A title that wasn't judged raises."""
    said = judged.where("source_title IS NOT NULL").select(F.concat(F.lit("t"), "source_title").alias("__title"), *(c for c in judged.columns if c != "source_title"))
    none = F.col("source_title").isNull()
    alone = F.concat(F.lit("n"), F.pmod(F.xxhash64("run_id", "video_id"), F.lit(SPREAD)).cast("string"))
    missing = F.when(none, "source_title_missing").otherwise(refuse(OutsideTitle, "a title wasn't judged", title=F.col("source_title")))
    keyed = videos.withColumn("__title", F.when(none, alone).otherwise(F.concat(F.lit("t"), "source_title")))
    return keyed.join(said, "__title", "left").withColumn("rule_reason", F.coalesce("rule_reason", missing)).drop("__title")


def resolve(videos: DataFrame, names: DataFrame, *, facts: DataFrame | None = None, pending: DataFrame | None = None, normalize: Callable[[Column], Column] = X.normalize, carry: list[str] | None = None, judged: DataFrame | None = None, extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """One outcome for each video: blank title, then an earlier final fact, then a pending review, then the rules.

    facts: run_id, video_id, method, candidate, decision, final_name, reason_code, artist_id, of one resolver version.
    pending: run_id, video_id, proposed_name, method, resolver_version. What the rules leave open needs review, unless
    ``extract`` gives a model's reply on a title, a JSON text or null for a failed call (C4): a candidate that the title
    holds is then pending, and any other reply is rejected for good. The rules' own reason is kept in rule_reason.
    Columns of videos named in ``carry`` come along, so what goes on with a video's numbers needs no join back to the
    videos. ``judged`` is what judge_titles() gives, if it is known already."""
    tried = attempts(videos, judge_titles(videos, name_index(names, normalize), normalize) if judged is None else judged)
    key = ["run_id", "video_id"]
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    if facts is not None:
        known = facts.select(*key, F.struct("method", "candidate", "decision", "final_name", "reason_code", "artist_id").alias("fact"))
        tried = tried.join(known, key, "left")
    else:
        tried = tried.select("*", none("fact", "struct<method:string,candidate:string,decision:string,final_name:string,reason_code:string,artist_id:string>"))
    if pending is not None:
        waiting = pending.where("status = 'pending'").select(*key, F.struct("proposed_name", "method", "resolver_version").alias("wait")) if "status" in pending.columns else pending.select(*key, F.struct("proposed_name", "method", "resolver_version").alias("wait"))
        tried = tried.join(waiting, key, "left")
    else:
        tried = tried.select("*", none("wait", "struct<proposed_name:string,method:string,resolver_version:string>"))
    blank, replayed, waits = F.col("rule_reason") == "source_title_missing", F.col("fact").isNotNull(), F.col("wait").isNotNull()
    accepted, outside = F.col("rule_reason") == "regex_autoaccepted", F.col("rule_reason") == "candidate_outside_source_title"
    conflict = F.col("wait.resolver_version") != RESOLVER_VERSION
    missing = F.lit(None).cast("string")
    if extract is not None:
        asked = ~(blank | replayed | waits | accepted | outside)
        tried = tried.withColumn("__reply", F.when(asked, extract(F.col("source_title"))))
        named, error = parse_reply(F.col("__reply"))
        within = X.is_supported(normalize(named), normalize(F.col("source_title")))
        fault = F.when(F.col("__reply").isNull(), "llm_call_failed").when(error.isNotNull(), error).when(named.isNull(), "llm_no_single_candidate").when(~F.coalesce(within, F.lit(False)), "candidate_outside_source_title")
        tried = tried.withColumn("__named", named).withColumn("__fault", fault)
        open_method, open_candidate = F.lit("llm_assisted"), F.when(F.col("__fault").isNull() | (F.col("__fault") == "candidate_outside_source_title"), F.col("__named"))
        open_decision, open_review = F.when(F.col("__fault").isNull(), "review_required").otherwise("rejected"), F.col("__fault").isNull()
        open_reason = F.coalesce("__fault", F.concat("rule_reason", F.lit(":llm_candidate_pending")))
    else:
        open_method, open_candidate, open_decision, open_review, open_reason = F.lit("unknown"), missing, F.lit("review_required"), F.lit(True), F.lit("llm_unavailable")

    def pick(blank_value, fact_field, wait_value, yes, no, review) -> Column:  # noqa: ANN001
        return F.when(blank, blank_value).when(replayed, F.col(f"fact.{fact_field}")).when(waits, wait_value).when(accepted, yes).when(outside, no).otherwise(review)

    stray = waits & ~blank & ~replayed & ~conflict & ~X.is_supported(normalize(F.col("wait.proposed_name")), normalize(F.col("source_title")))
    reused = F.when(conflict, "pending_resolver_version_conflict").when(stray, refuse(OutsideTitle, "a pending candidate isn't in its title", video_id=F.col("video_id"))).otherwise("pending_candidate_reused")
    return tried.select(
        *key,
        pick(F.lit("unknown"), "method", F.col("wait.method"), F.lit("regex"), F.lit("regex"), open_method).alias("method"),
        pick(missing, "candidate", F.col("wait.proposed_name"), F.col("rule_candidate"), F.col("rule_candidate"), open_candidate).alias("candidate"),
        pick(F.lit("rejected"), "decision", F.lit("review_required"), F.lit("accepted"), F.lit("rejected"), open_decision).alias("decision"),
        pick(missing, "final_name", missing, F.col("rule_candidate"), missing, missing).alias("final_name"),
        pick(F.lit("source_title_missing"), "reason_code", reused, F.col("rule_reason"), F.col("rule_reason"), open_reason).alias("reason_code"),
        pick(missing, "artist_id", missing, F.col("rule_artist_id"), missing, missing).alias("artist_id"),
        F.when(blank | replayed, False).when(waits, True).when(accepted | outside, False).otherwise(open_review).alias("needs_review"),
        ((replayed | waits) & ~blank).alias("replayed"),
        "rule_reason",
        *(carry or []),
    )


def final_mappings(outcomes: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """P5: run_id, video_id and artist_id of what is accepted, needs no review and has an entity, and the carried columns."""
    return outcomes.where("decision = 'accepted' AND NOT needs_review AND artist_id IS NOT NULL").select("run_id", "video_id", "artist_id", *(carry or []))


def parse_reply(reply: Column) -> tuple[Column, Column]:
    """(candidate, error) of a model's reply, which must be a JSON object with the one field candidate, a text or null,
    and nothing before or after it. A reply that repeats the field is refused, as it doesn't say which one counts."""
    whole = strict(reply)
    kind = F.schema_of_variant(F.try_variant_get(whole, "$[0].candidate", "variant"))
    keys = F.json_object_keys(F.when(whole.isNotNull(), reply))
    good = F.coalesce((F.size(keys) == 1) & (keys[0] == "candidate") & kind.isin("STRING", "VOID"), F.lit(False))
    return F.when(good, F.try_variant_get(whole, "$[0].candidate", "string")), F.when(~good, "llm_contract_violation")
