"""Intermediate tables: written once to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, a temporary folder is set if driver and
    executors are one process; on a cluster its disks aren't shared, so that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = f"file://{tempfile.mkdtemp(prefix='gaugeline-')}"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/gaugeline-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read again: this cuts the lineage and survives lost executors.

    Times are kept as microseconds, which Parquet packs where Spark's own form of them takes 12 bytes each."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    times = [c for c, kind in df.dtypes if kind == "timestamp"]
    kept = df.withColumns({c: F.unix_micros(c) for c in times}) if times else df
    kept.write.parquet(path)
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    return back.withColumns({c: F.timestamp_micros(c) for c in times}) if times else back


def drop_tables(df: DataFrame) -> None:
    """Removes the intermediate tables that df is read from; df can't be read after that."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f[: f.index("/", at)] for f in df.inputFiles() if (at := f.find("/gaugeline-") + 1)}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
