"""Two rounds over one frozen input must give the same digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from gaugeline.errors import NotNullViolation, refuse, typed_errors
from gaugeline.plans.config import COMPARISON_CONTRACT


def set_digest(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """For each group the SHA-256 of its sorted distinct values as a JSON list of texts.

    Sorted rows stream through the hash, so no list of a group is held, however large it is."""
    schema = StructType([*rows.select(*group).schema.fields, StructField("digest", StringType())])
    to = to_arrow_schema(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, so_far = None, None
        for batch in batches:
            done = []
            for *key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if so_far is not None:
                        so_far.update(b"]")
                        done.append((*now, so_far.hexdigest()))
                    now, so_far = key, hashlib.sha256(b"[")
                    so_far.update(value.encode())
                else:
                    so_far.update(b"," + value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(to)], schema=to)
        if so_far is not None:
            so_far.update(b"]")
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, so_far.hexdigest()), to, strict=True)], schema=to)

    quoted = F.regexp_extract(F.to_json(F.array(F.col("__value").cast("string"))), r"(?s)^\[(.*)\]$", 1)
    one_each = rows.where(F.col(column).isNotNull()).select(*group, F.col(column).alias("__value")).distinct()
    dealt = one_each.repartition(*group).sortWithinPartitions(*group, F.col("__value").cast("string")).select(*group, quoted.alias("__quoted"))
    return dealt.mapInArrow(digests, schema)


def row_digests(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A digest of each key's rows that doesn't depend on their order, without gathering them: the digests of rows are summed."""
    one = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    part = lambda at: F.sum(F.conv(F.substring("__d", at, 12), 16, 10).cast("decimal(38,0)"))
    sums = rows.withColumn("__d", one).groupBy(*key).agg(F.count("*").alias("n"), *(part(a).alias(f"__s{a}") for a in (1, 13, 25, 37)))
    return sums.select(*key, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"__s{a}").cast("string") for a in (1, 13, 25, 37))), 256).alias("digest"))


def compare_rounds(evidence: DataFrame) -> DataFrame:
    """For each session the report pairs of rounds 1 and 2 and how many differ; a missing digest differs."""
    of = lambda n: evidence.where(F.col("round") == n).select("session_id", "report_id", F.col("digest").alias(f"d{n}"))
    pairs = of(1).join(of(2), ["session_id", "report_id"], "full")
    return pairs.groupBy("session_id").agg(F.count_if(F.col("d1").isNotNull() & F.col("d2").isNotNull()).alias("pairs"), F.count_if(~F.col("d1").eqNullSafe(F.col("d2"))).alias("mismatches"))


def pass_gate(sessions: DataFrame, rounds: DataFrame, evidence: DataFrame) -> DataFrame:
    """(session_id, violation) of sessions that may not pass; none if all is well."""
    r = rounds.groupBy("session_id").agg(
        F.count_if(F.col("round") == 1).alias("r1"), F.count_if(F.col("round") == 2).alias("r2"),
        *(F.count_distinct(c).alias(f"n_{c}") for c in ("source_run_id", "snapshot_hash", "engine_version", "manifest_hash")),
        F.bool_and(F.col("manifest_hash").rlike("^[0-9a-f]{64}$")).alias("hex"),
    )
    e = evidence.groupBy("session_id").agg(F.count_if(F.col("round") == 1).alias("e1"), F.count_if(F.col("round") == 2).alias("e2"), F.count_distinct("report_id").alias("reports"))
    all_ = sessions.join(r, "session_id", "left").join(e, "session_id", "left").join(compare_rounds(evidence), "session_id", "left")
    rules = {
        "contract": F.col("contract") == COMPARISON_CONTRACT, "two_reports": F.col("reports") == 2, "rounds": (F.col("r1") == 1) & (F.col("r2") == 1),
        "same_source": F.col("n_source_run_id") == 1, "same_snapshot": F.col("n_snapshot_hash") == 1, "same_engine": F.col("n_engine_version") == 1,
        "same_manifest": (F.col("n_manifest_hash") == 1) & F.col("hex"), "evidence": (F.col("e1") == 2) & (F.col("e2") == 2), "pairs": F.col("pairs") == 2, "no_mismatch": F.col("mismatches") == 0,
    }
    broken = F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return all_.select("session_id", F.explode(F.array_compact(broken)).alias("violation"))


def apply_review(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewed outcomes (run_id, video_id, candidate, ...) with people's decisions (approved, artist_id); an approval needs an entity."""
    d = decisions.select("run_id", "video_id", "approved", F.col("artist_id").alias("__artist"))
    named = F.when(F.col("approved") & (F.coalesce(F.trim("__artist"), F.lit("")) == ""), refuse(NotNullViolation, "an approval without an entity", video_id=F.col("video_id"))).when(F.col("approved"), F.col("__artist"))
    return outcomes.join(d, ["run_id", "video_id"]).select(
        "run_id", "video_id", F.lit("human_override").alias("method"), "candidate",
        F.when(F.col("approved"), "accepted").otherwise("rejected").alias("decision"),
        F.when(F.col("approved"), F.col("candidate")).alias("final_name"),
        F.when(F.col("approved"), "human_approved").otherwise("human_rejected").alias("reason_code"),
        named.alias("artist_id"),
    )


def latest_facts(facts: DataFrame, resolver_version: str) -> DataFrame:
    """The latest fact of each video for one resolver version; the id decides between equal times."""
    order = Window.partitionBy("run_id", "video_id").orderBy(F.desc("created_at"), F.desc("fact_id"))
    return facts.where(F.col("resolver_version") == resolver_version).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def freeze(rows: DataFrame, path: str) -> DataFrame:
    """Rows written once and read back; both rounds read this."""
    with typed_errors():
        rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def missing_facts(needed: DataFrame, facts: DataFrame) -> DataFrame:
    """Videos of the frozen input without a fact; must be empty before round 2."""
    return needed.select("run_id", "video_id").join(facts.select("run_id", "video_id"), ["run_id", "video_id"], "left_anti")


def derived_id(namespace: int, number: str) -> str:
    """F27 as SQL: a stable id of a namespace and a number."""
    return f"format_string('%08x-0000-4000-8000-%012x', {namespace}, {number})"
