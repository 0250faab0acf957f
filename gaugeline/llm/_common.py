"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.tables import drop_tables, shared_dir, written

__all__ = ["ROWS", "SPACES", "WORD", "drop_tables", "map_columns", "read_table", "row_key", "shared_dir", "tokenizer_path", "written"]

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
ROWS = 500  # rows of a batch that are held as Python objects at once


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name_or_path: str) -> str:
    """A vocabulary file by its path, or by its name among the installed public ones."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def map_columns(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[list[list]]], schema: str) -> DataFrame:
    """mapInArrow over plain Python columns: fn gets and gives an iterator of lists of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn([c.to_pylist() for c in b.slice(k, ROWS).columns] for b in batches for k in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def row_key(df: DataFrame) -> Column:
    """A hash of all columns that tells which of them are null; maps, which have no hash, are taken as JSON."""
    parts: list[Column] = []
    for field in df.schema:
        c = df[f"`{field.name}`"]
        parts += [c.isNull(), F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c]
    return F.xxhash64(*parts)
