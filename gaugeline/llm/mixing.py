"""Mixing sources to target weights: a curriculum whose weights change while training goes on.

Each source has a schedule of weights over training time, scaled so that its integral is the source's
target. A document's place among its source's words, in hashed order and pass after pass, is a point of
the source's cumulative demand; the inverse of the demand at that point is the document's training
position, and documents are range-sorted by it. Everything is made of DataFrame functions.

A source's running sums are taken in hashed ranges: a sum for each range, running sums over a source's
ranges, then running sums within a range. The hash is that of id and text, so rows without an id, or with
one id, are spread too, and there are as many ranges as keep them at some ``RANGE_ROWS`` rows. So no task
holds a source, however large; one task holds a row for each source.

Defined results: a null text has size 0; null is a source of its own, the last; an empty table gives
no rows. Rows with the same id are each mixed for themselves; those alike in id, source and text may
change places. A source without words has target 0, and its documents are taken 0 times.
Extra columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm._common import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # 150 % of all sizes
MOST = 2  # passes over a source
RANGE_ROWS = 100_000  # rows of a hashed range, of which a source has 256 at least
BROADCAST_RANGES = 200_000  # ranges of all sources, of some 100 bytes each; more are joined by a shuffle
#: (time, relative weight) points of each schedule, taken by turns like WEIGHTS: falling, level, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))


def word_count(text: Column) -> Column:
    """Words of a text, without making an array of them: the ends of words are counted by what is left out."""
    ends = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), r"[\x20\x09-\x0D]+", "")
    return F.length(ends).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, turn and target of each source of ``sizes`` (source, source_size).

    The water level is the share of a unit of weight at which all targets, none above its source's bound, add up
    to the total. Sources in order of bound by weight: those before the level are at their bounds."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    ranked = sizes.withColumn("turn", turn.cast("int"))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("turn") + 1).cast("long")).withColumn("bound", MOST * F.col("source_size"))
    by_bound = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_bound.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    levels = (
        weighed.withColumn("__bounds", F.coalesce(F.sum("bound").over(before), F.lit(0)))
        .withColumn("__weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__total", SHARE[0] * F.sum("source_size").over(everything) / SHARE[1])
        .withColumn("__level", (F.col("__total") - F.col("__bounds")) / F.col("__weights"))
        .withColumn("__fits", F.col("__level") <= F.col("bound") / F.col("weight"))
    )
    level = F.first(F.when(F.col("__fits"), F.col("__level")), ignorenulls=True).over(by_bound.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.withColumn("__water", level).select(
        "source", "source_size", "turn",
        F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("bound").cast("double"), F.coalesce(F.col("weight") * F.col("__water"), F.col("bound").cast("double")))).alias("target"),
    )


def demand_inverse(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral, scaled to 1, comes to ``share``; weights are linear between points."""
    parts = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, done, out = sum(parts), 0.0, None
    for (t0, w0), (t1, w1), part in zip(schedule, schedule[1:], parts, strict=False):
        left = share * whole - done
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = left, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + (2 * slope) * left))
        time = F.least(F.lit(t1), t0 + 2 * left / F.greatest(w0 + root, F.lit(1e-12)))
        done += part
        out = F.when(share * whole <= done, time) if out is None else out.when(share * whole <= done, time)
    return out.otherwise(schedule[-1][0])


def order_hash(doc_id: Column, text: Column) -> Column:
    """What orders a source's documents."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def placed(sized: DataFrame, rows: int) -> DataFrame:
    """sized (source, size, __hash, ...) with source_size, target, __turn, __start, the words of the source before the
    document, and __passes. The words before the target's end are taken, so all but one document of a source are
    taken whole in each pass; __passes, for ``mixed``, counts those of which at least half is taken."""
    digits = 2 + max(0, math.ceil(math.log(max(rows, 1) / (256 * RANGE_ROWS), 16)))
    sized = sized.withColumn("__range", F.substring("__hash", 1, digits))
    ranges = sized.groupBy("source", "__range").agg(F.sum("size").alias("__in"))
    upto = W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("__before", F.coalesce(F.sum("__in").over(upto), F.lit(0)))
    goals = targets(ranges.groupBy("source").agg(F.sum("__in").alias("source_size")))
    known = written(
        starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(
            starts["source"].alias("__source"), F.col("__range").alias("__known"), "__before", goals["source_size"], F.col("turn").alias("__turn"), "target"
        ),
        "ranges",
    )
    if known.count() <= BROADCAST_RANGES:
        known = F.broadcast(known)
    within = W.partitionBy("source", "__range").orderBy("__hash").rowsBetween(W.unboundedPreceding, -1)
    summed = sized.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    start = F.col("__before") + F.col("__within")
    out = summed.join(known, summed["source"].eqNullSafe(known["__source"]) & (F.col("__range") == F.col("__known"))).withColumn("__start", start)
    end = F.floor(F.col("target") + 0.5)
    offsets = [p * F.col("source_size") + F.col("__start") for p in range(MOST)]
    halves = sum((o * 2 + F.col("size") <= 2 * end).cast("int") for o in offsets)
    return out.withColumn("__passes", F.when(F.col("size") > 0, halves).otherwise(0))


def passes(docs: DataFrame) -> DataFrame:
    """The mix in passes, range-sorted by training position and written: doc_id, source, size, source_size, target,
    __start, __pass, __words (that the pass takes, all but the last of a source whole) and __position. What isn't
    taken has one pass without words or position; __none tells rows without words apart."""
    own = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("__hash")), "sizes")
    end = F.floor(F.col("target") + 0.5)
    words = F.array(*(F.least(F.greatest(end - p * F.col("source_size") - F.col("__start"), F.lit(0)), F.col("size")).cast("long") for p in range(MOST)))
    known = ("doc_id", "source", "size", "source_size", "target", "__start")
    dealt = placed(own, own.count()).select(*known, "__turn", F.posexplode(words).alias("__pass", "__words")).where("__pass = 0 OR __words > 0")
    timed = dealt.withColumn("__position", F.when(F.col("__words") > 0, position(F.col("__pass")))).orderBy("__position", "doc_id", "__pass")
    return written(timed.select(*known, "__pass", "__words", "__position", F.when(F.col("size") == 0, F.monotonically_increasing_id()).alias("__none")), "mix")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the passes of the mix take) of each document,
    positions: when in training, from 0 to 1, its passes come; and first_position, null if it isn't taken."""
    known = ("doc_id", "source", "size", "source_size", "target")
    of_each = passes(docs).groupBy(*known, "__start", "__none").agg(F.sum("__words").alias("taken"), F.min("__position").alias("first_position"), F.array_sort(F.collect_list("__position")).alias("positions"))
    return of_each.select(*known, "taken", "first_position", "positions")


def position(taken_before: Column) -> Column:
    """The training position of a document's pass number ``taken_before``."""
    share = (taken_before * F.col("source_size") + F.col("__start") + F.col("size") / 2) / F.col("target")
    out = None
    for k, schedule in enumerate(SCHEDULES):
        here = demand_inverse(share, schedule)
        out = F.when(F.col("__turn") == k, here) if out is None else out.when(F.col("__turn") == k, here)
    return out


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: docs' whole rows, one for each pass that takes at least half of it, range-sorted by training position."""
    names = docs.columns
    own = docs.select(F.struct(*(F.col(c) for c in names)).alias("__whole"), "source", word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("__hash"))
    dealt = placed(own, docs.count()).select("__whole", "source_size", "size", "target", "__start", "__turn", F.explode(F.when(F.col("__passes") > 0, F.sequence(F.lit(0), F.col("__passes") - 1))).alias("__pass"))
    timed = dealt.withColumn("__position", position(F.col("__pass")))
    return timed.orderBy("__position", "__whole.doc_id", "__pass").select("__whole.*")


def _inverse_sql(schedule: tuple[tuple[float, float], ...]) -> str:
    """The time at which a schedule's share x of its integral is reached, in DuckDB."""
    parts = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    out, done = "CASE", 0.0
    for (t0, w0), (t1, w1), part in zip(schedule, schedule[1:], parts, strict=False):
        left, slope = f"(x * {sum(parts)}::DOUBLE - {done}::DOUBLE)", (w1 - w0) / (t1 - t0)
        done += part
        out += f" WHEN x * {sum(parts)}::DOUBLE <= {done}::DOUBLE THEN least({t1}::DOUBLE, {t0}::DOUBLE + 2 * {left} / greatest({w0}::DOUBLE + sqrt(greatest(0::DOUBLE, {w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {left})), 1e-12::DOUBLE))"
    return f"{out} ELSE {schedule[-1][0]}::DOUBLE END"


#: The query over documents in DuckDB.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn, [3, 1, 2][turn + 1] AS weight, 2 * source_size AS bound
  FROM sources),
levels AS (
  SELECT *,
    ((3 * sum(source_size) OVER ())::DOUBLE / 2 - coalesce(sum(bound) OVER before, 0)::DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked
  WINDOW before AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT first(level ORDER BY bound / weight, source NULLS LAST) AS water FROM levels WHERE level <= bound / weight),
goals AS (
  SELECT source, source_size, turn,
    CASE WHEN source_size = 0 THEN 0.0 ELSE least(bound::DOUBLE, coalesce(weight * water, bound::DOUBLE)) END AS target
  FROM levels CROSS JOIN water),
ordered AS (
  SELECT doc_id, s.source, size, source_size, target, turn,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    floor(target + 0.5)::BIGINT AS stop
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, (least(greatest(stop - start, 0), size) + least(greatest(stop - source_size - start, 0), size))::BIGINT AS taken,
    (start + size / 2)::DOUBLE / nullif(target, 0) AS x
  FROM ordered)
SELECT doc_id, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN
  CASE turn {" ".join(f"WHEN {k} THEN {_inverse_sql(s)}" for k, s in enumerate(SCHEDULES))} END END, 8) AS first_position
FROM taken
"""
