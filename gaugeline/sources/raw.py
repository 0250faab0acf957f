"""Landed collection bodies: projection with fail-closed casts, pagination, and write-once runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeline.errors import CountExpected, FieldMissing, MalformedBody, TextExpected, TransportKeys, WrongKind, refuse, typed_errors
from gaugeline.functions.strict import strict
from gaugeline.tables import written

# Keys of a transport that a body must not carry, kinds of bodies, and the collection's limits.
VIDEO_KIND, CHANNEL_KIND = "youtube#video", "youtube#channel"
TRANSPORT_KEYS = ("config", "request", "headers", "authorization", "key")
TARGET_VIDEOS, BATCH, HARD_CAP, SURPLUS_CAP, PAGE_CEILING = 500, 50, 2000, 500, 100
VIDEO_SCHEMA = "struct<kind:string,id:string,snippet:struct<channelId:string,title:string,publishedAt:string>,statistics:struct<viewCount:string,likeCount:string,commentCount:string>>"
CHANNEL_SCHEMA = "struct<kind:string,id:string,snippet:struct<title:string>,statistics:struct<videoCount:string,subscriberCount:string,viewCount:string>>"
PAGE_SCHEMA = "struct<kind:string,items:array<struct<id:struct<kind:string,videoId:string>>>,nextPageToken:string>"


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One JSON body a line, verbatim."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def required(value: Column, name: str) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), refuse(FieldMissing, "a field is missing", field=name)).otherwise(value)


def count_or_null(value: Column) -> Column:
    """Absent stays null, "0" is 0, junk raises."""
    number = value.try_cast("bigint")
    return F.when(value.isNotNull() & number.isNull(), refuse(CountExpected, "a counter isn't a whole number", value=value).cast("bigint")).otherwise(number)


def carries_transport(body: Column) -> Column:
    """P4."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(body), F.array(*map(F.lit, TRANSPORT_KEYS))), F.lit(False))


def checked(body: Column, kind: str, texts: tuple[str, ...]) -> Column:
    """A body that may be projected, or an error: it is one JSON value and nothing else, has the kind, no transport keys (P4),
    and text at the paths if anything. A key that an object repeats is refused with what isn't JSON. What is asked of a body is
    asked of one parse, bound as an array's one element."""

    def told(whole: Column) -> Column:
        at = lambda path: F.try_variant_get(whole, f"$[0].{path}", "variant")
        strange = reduce(Column.__or__, (F.coalesce(~F.schema_of_variant(at(path)).isin("STRING", "VOID"), F.lit(False)) for path in texts), F.lit(False))
        return (
            F.when(body.isNotNull() & whole.isNull(), refuse(MalformedBody, "the body isn't one JSON value"))
            .when(reduce(Column.__or__, (at(key).isNotNull() for key in TRANSPORT_KEYS)), refuse(TransportKeys, "the body carries transport keys"))
            .when(~F.try_variant_get(whole, "$[0].kind", "string").eqNullSafe(F.lit(kind)), refuse(WrongKind, "the body is of another kind", expected=kind))
            .when(strange, refuse(TextExpected, "a text of the body isn't text", kind=kind))
            .otherwise(body)
        )

    return F.transform(F.array(strict(body)), told)[0]


def project_videos(bodies: DataFrame) -> DataFrame:
    """P1. Bodies of another kind, with transport keys, or with ids, titles or times that aren't text raise."""
    kept = [c for c in bodies.columns if c != "body"]
    good = bodies.withColumn("__body", checked(F.col("body"), VIDEO_KIND, ("id", "snippet.channelId", "snippet.title", "snippet.publishedAt")))
    return good.withColumn("__v", F.from_json("__body", VIDEO_SCHEMA)).select(
        *kept,
        required(F.col("__v.id"), "id").alias("video_id"),
        required(F.col("__v.snippet.channelId"), "channelId").alias("channel_id"),
        F.col("__v.snippet.title").alias("source_title"),
        count_or_null(F.col("__v.statistics.viewCount")).alias("views"),
        count_or_null(F.col("__v.statistics.likeCount")).alias("likes"),
        count_or_null(F.col("__v.statistics.commentCount")).alias("comments"),
        F.col("__v.snippet.publishedAt").cast("timestamp").alias("published_at"),
    )


def project_channels(bodies: DataFrame) -> DataFrame:
    """P2, as fail-closed as P1."""
    kept = [c for c in bodies.columns if c != "body"]
    good = bodies.withColumn("__body", checked(F.col("body"), CHANNEL_KIND, ("id", "snippet.title")))
    return good.withColumn("__c", F.from_json("__body", CHANNEL_SCHEMA)).select(
        *kept,
        required(F.col("__c.id"), "id").alias("channel_id"),
        F.col("__c.snippet.title").alias("title"),
        count_or_null(F.col("__c.statistics.subscriberCount")).alias("subscriber_count"),
        count_or_null(F.col("__c.statistics.viewCount")).alias("view_count"),
        count_or_null(F.col("__c.statistics.videoCount")).alias("upload_count"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """(run_id, page, item, video_id) of search pages (run_id, page, body)."""
    return pages.select("run_id", "page", F.posexplode(F.from_json("body", PAGE_SCHEMA)["items"]).alias("item", "i")).select("run_id", "page", "item", F.col("i.id.videoId").alias("video_id"))


def first_unique(items: DataFrame, most: int = TARGET_VIDEOS) -> DataFrame:
    """Ids that aren't empty by their first place, up to ``most`` a run; the first place is a plain aggregate, the cap a ranked window."""
    first = items.where("video_id <> ''").groupBy("run_id", "video_id").agg(F.min(F.struct("page", "item")).alias("at"))
    order = Window.partitionBy("run_id").orderBy("at", "video_id")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("run_id", "video_id", "position")


def batches(ids: DataFrame, size: int = BATCH) -> DataFrame:
    """W9."""
    return ids.withColumn("batch", F.ceil(F.col("position") / size).cast("int"))


def walk_pages(spark: SparkSession, pages: DataFrame, most: int = 1000) -> DataFrame:
    """run_id, page_token, next_token and step of the walk along next tokens from each run's first page, of ``most`` steps at most.

    Pointer jumping: each round doubles the hops that are known, and is written, so a chain of 1,000 pages takes ten
    rounds and no recursion. A token that leads back is walked again until ``most``; pages.stops() refuses it."""
    known = written(pages.select("run_id", "page_token", "next_token"), "pages")
    reached = known.where("page_token IS NULL").select("run_id", "page_token", "next_token", F.lit(1).alias("step"))
    by_token = known.where("page_token IS NOT NULL").select("run_id", F.col("page_token").alias("at"), F.col("page_token").alias("end"), F.col("next_token").alias("after"))
    hops, length, done = by_token, 1, 1
    while done < most:
        # From every page reached so far, ``length`` hops on; hops: at, and the page ``length - 1`` hops after it.
        far = reached.where(F.col("step") + length <= most).join(hops.withColumnRenamed("at", "next_token"), ["run_id", "next_token"]).select("run_id", F.col("end").alias("page_token"), F.col("after").alias("next_token"), (F.col("step") + length).alias("step"))
        if (far := written(far, "far")).isEmpty():
            break
        reached, done, length = written(reached.union(far), "reached"), done + length, 2 * length
        on = hops.select("run_id", F.col("at").alias("after"), F.col("end").alias("end2"), F.col("after").alias("after2"))
        hops = written(hops.join(on, ["run_id", "after"]).select("run_id", "at", F.col("end2").alias("end"), F.col("after2").alias("after")), "hops")
    return reached


def token_chain(spark: SparkSession, pages: DataFrame, most: int = 1000) -> DataFrame:
    """run_id, page_token and step of walk_pages()."""
    return walk_pages(spark, pages, most).select("run_id", "page_token", "step")


LEDGER = "total long, surplus long, accepted boolean"


def quota_ledger(charges: DataFrame, cap: int = HARD_CAP, surplus_cap: int = SURPLUS_CAP) -> DataFrame:
    """Charges (run_id, seq, units, is_retry) in order, each with whether it is accepted and what is spent after it.

    A charge is judged before it is spent: a retry by the surplus, all by the total. A refused one changes neither, so
    later ones are judged by what was really spent. That is a fold over a run in order: rows stream through it, sorted
    by run and seq, and only two numbers are held."""
    names = charges.columns
    at = {c: names.index(c) for c in ("run_id", "units", "is_retry")}
    schema = StructType([*charges.schema.fields, *StructType.fromDDL(LEDGER).fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, surplus = None, 0, 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for run, units, retry in zip(*(batch.column(at[c]).to_pylist() for c in ("run_id", "units", "is_retry")), strict=True):
                if run != now:
                    now, total, surplus = run, 0, 0
                good = total + units <= cap and not (retry and surplus + units > surplus_cap)
                if good:
                    total += units
                    surplus += units if retry else 0
                for column, value in zip(out, (total, surplus, good), strict=True):
                    column.append(value)
            new = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "total", "surplus", "accepted"])

    return charges.repartition("run_id").sortWithinPartitions("run_id", "seq").mapInArrow(fold, schema)


def window_bounds(now: Column, days: int = 30) -> Column:
    """(window_start, window_end) of a run that begins ``now``; the clock is the caller's."""
    return F.struct((now - F.expr(f"INTERVAL {days} DAYS")).alias("window_start"), now.alias("window_end"))


def rfc3339(at: Column) -> Column:
    """an instant in UTC, to the second; the session's time zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_run(rows: DataFrame, path: str) -> None:
    """A run's rows, once: a folder that exists is an error, as an update of raw rows would be. store.RunStore is for many writers."""
    with typed_errors():
        rows.write.mode("errorifexists").parquet(path)


def new_rows(rows: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key the target lacks, one of each key; appending them twice adds nothing."""
    return rows.join(target.select(*key), key, "left_anti").dropDuplicates(key)


def run_scan(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run of a table partitioned by run_id."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def run_states(marks: DataFrame) -> DataFrame:
    """Each run's state from its marks (run_id, mark): failed beats finalized beats collecting."""
    order = F.when(F.col("mark") == "failed", 3).when(F.col("mark") == "finalized", 2).when(F.col("mark") == "collecting", 1).otherwise(0)
    return marks.groupBy("run_id").agg(F.max(order).alias("n")).select("run_id", F.element_at(F.array(*map(F.lit, ("created", "collecting", "finalized", "failed"))), F.col("n") + 1).alias("state"))


def returned_ids(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """U4: ids that are missing, extra or repeated in a reply, with what is wrong; none if all is well."""
    counts = returned.groupBy("video_id").agg(F.count("*").alias("n"))
    both = requested.select("video_id", F.lit(1).alias("asked")).join(counts, "video_id", "full")
    wrong = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return both.select("video_id", wrong.alias("fault")).where("fault IS NOT NULL")
