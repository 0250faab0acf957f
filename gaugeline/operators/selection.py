"""Exact percentiles of groups of any size.

Spark's ``percentile`` keeps a group's distinct values in one task. Groups of more than ``hot_rows`` values are worked out by
selection instead: doubles are taken as 64-bit integers of the same order, and four rounds of histograms, each over the next
16 bits of the values that are still in question, give the order statistics bit by bit. A histogram has at most 65,536 rows
for a group, made with partial sums in each task, so nothing holds a group. Both ways give the same numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gaugeline.tables import written

HOT_ROWS = 1 << 20
BITS, ROUNDS = 16, 4


def _mapped(rows: DataFrame, column: str, to: str, kind: DoubleType | LongType, fn) -> DataFrame:  # noqa: ANN001
    """rows with ``column`` taken through fn (of a numpy array) and named ``to``."""
    schema = StructType([f for f in rows.schema.fields if f.name != column] + [StructField(to, kind)])
    target = to_arrow_schema(schema)
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [c for k, c in enumerate(batch.columns) if k != at]
            made = pa.array(fn(batch.column(at).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*others, made], target, strict=True)], schema=target)

    return rows.mapInArrow(run, schema)


def _flipped(bits: np.ndarray) -> np.ndarray:
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; -0.0 is 0.0, and what isn't a number comes last."""
    return _flipped((np.where(np.isnan(values), np.nan, values) + 0.0).view(np.int64))


def from_bits(bits: np.ndarray) -> np.ndarray:
    return _flipped(np.ascontiguousarray(bits, np.int64)).view(np.float64)


def order_statistics(rows: DataFrame, key: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """wanted (key, name, rank from 0) with ``x``, the value of that rank among its key's values."""
    coded = written(_mapped(rows.select(*key, F.col(value).cast("double").alias("__v")), "__v", "__bits", LongType(), ordered_bits), "bits")
    state = written(wanted.select(*key, "name", "rank", F.lit(0).cast("long").alias("prefix")), "wanted")
    for level in range(ROUNDS):
        shift = 64 - BITS * (level + 1)
        digit = F.shiftright("__bits", shift).bitwiseAND(F.lit((1 << BITS) - 1)) if level else F.shiftright("__bits", shift)
        above = F.shiftright("__bits", shift + BITS) if level else F.lit(0).cast("long")
        open_ = state.select(*key, F.col("prefix")).distinct()
        counts = coded.withColumn("prefix", above).join(open_, [*key, "prefix"], "left_semi").groupBy(*key, "prefix", digit.alias("digit")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*key, "prefix").orderBy("digit"))
        placed = counts.withColumn("upto", upto).join(state, [*key, "prefix"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        longer = F.shiftleft("prefix", BITS).bitwiseOR(F.col("digit")) if level else F.col("digit")
        state = written(placed.select(*key, "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), longer.alias("prefix")), f"digits{level}")
    return _mapped(state.drop("rank"), "prefix", "x", DoubleType(), from_bits)


def percentiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], *, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """For each key the exact percentiles of its values that aren't null, by name, linear between neighbours; null if it has none.

    sizes: key and n, at least as many as its values, if that is known; else the rows are counted. Keys must not be null."""
    if sizes is None:
        sizes = rows.groupBy(*key).agg(F.count(value).alias("n"))
    hot = written(sizes.where(F.col("n") > hot_rows).select(*key), "hot")
    plain = [F.percentile(value, F.lit(share)).alias(name) for name, share in shares.items()]
    if hot.isEmpty():
        return rows.groupBy(*key).agg(*plain)
    few = rows.join(hot, key, "left_anti").groupBy(*key).agg(*plain)
    many = rows.join(hot, key, "left_semi")
    counts = many.groupBy(*key).agg(F.count(value).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("share_name"), F.lit(share).alias("share")) for name, share in shares.items())))
    place = (F.col("n") - 1) * F.col("share")
    ranks = written(counts.select(*key, "n", each.alias("s")).select(*key, "n", "s.*").where("n > 0").withColumn("place", place), "ranks")
    ends = ranks.select(*key, F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    found = order_statistics(many.where(F.col(value).isNotNull()), key, value, ends.select(*key, F.col("rank").cast("string").alias("name"), F.col("rank").cast("long").alias("rank")).distinct())
    at = lambda name: found.select(*key, F.col("name").cast("long").alias(f"__{name}_rank"), F.col("x").alias(f"__{name}"))
    both = ranks.withColumn("__low_rank", F.floor("place").cast("long")).withColumn("__high_rank", F.ceil("place").cast("long")).join(at("low"), [*key, "__low_rank"]).join(at("high"), [*key, "__high_rank"])
    between = (F.col("__high_rank") - F.col("place")) * F.col("__low") + (F.col("place") - F.col("__low_rank")) * F.col("__high")
    values = both.select(*key, "share_name", F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(between).alias("x"))
    named = values.groupBy(*key).agg(*(F.max(F.when(F.col("share_name") == name, F.col("x"))).alias(name) for name in shares))
    return few.unionByName(counts.select(*key).join(named, key, "left"))
