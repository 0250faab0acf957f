"""Runs that are written once, many at a time, and read whole or not at all.

A store is three folders. A writer first claims its runs: it writes a row for each, then reads all claims; if another
writer's claim stands for one of them it withdraws and is refused, so of two writers that meet at most one goes on, in
whatever order the storage shows their files. Rows are staged in partitions of attempt and run. A run is published by its
row in the manifest, one file that is written only after all of its rows are there. Readers join the manifest, so they see
no attempt that wasn't published, and a scan of one run reads its partition alone. All of it is done by Spark's own writers,
each in a folder of its own; nothing is locked, and nothing is ever changed or removed."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gaugeline.errors import NotNullViolation, RunExists, RunMissing

CLAIMS = "run_id string, attempt string, mark string"
MANIFEST = "run_id string, attempt string, n long"


@dataclass
class RunStore:
    """Runs under one folder, which the driver and all executors share."""

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/*")
        except AnalysisException as error:  # nothing was written yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def claims(self) -> DataFrame:
        """run_id and attempt of the claims that stand."""
        marks = self._read("claims", CLAIMS)
        return marks.where("mark = 'claimed'").join(marks.where("mark = 'withdrawn'").select("run_id", "attempt"), ["run_id", "attempt"], "left_anti").select("run_id", "attempt")

    def manifest(self) -> DataFrame:
        """run_id, attempt and n (rows) of the published runs."""
        return self._read("manifest", MANIFEST)

    def claim(self, runs: DataFrame, attempt: str) -> None:
        """Claims the runs (run_id) for one attempt, all or none."""
        mark = [F.lit(attempt).alias("attempt"), F.lit("claimed").alias("mark")]
        runs.select("run_id", *mark).write.parquet(f"{self.folder}/claims/{attempt}-claimed")
        own = self.spark.read.schema(CLAIMS).parquet(f"{self.folder}/claims/{attempt}-claimed")
        others = self.claims().where(F.col("attempt") != attempt).join(own.select("run_id"), "run_id", "left_semi").limit(5).collect()
        if others:
            self.withdraw(attempt)
            raise RunExists("a run is written or claimed already", runs=sorted({r.run_id for r in others}))

    def withdraw(self, attempt: str) -> None:
        """Gives up an attempt's claims: those of a writer that was refused, or that is known to be gone. Published runs stay."""
        own = self.spark.read.schema(CLAIMS).parquet(f"{self.folder}/claims/{attempt}-claimed").select("run_id", "attempt")
        rest = own.join(self.manifest().select("run_id", "attempt"), ["run_id", "attempt"], "left_anti")
        rest.withColumn("mark", F.lit("withdrawn")).write.mode("overwrite").parquet(f"{self.folder}/claims/{attempt}-withdrawn")

    def write(self, rows: DataFrame) -> str:
        """Publishes all runs of rows (run_id and more), or refuses all of them; the attempt's name.

        Large runs are split over tasks. A writer that fails withdraws; of one that dies the claims stand until someone does."""
        if not rows.where("coalesce(trim(run_id), '') = ''").isEmpty():
            raise NotNullViolation("a row without a run")
        attempt = uuid.uuid4().hex
        self.claim(rows.select("run_id").distinct(), attempt)
        staged = f"{self.folder}/rows/attempt={attempt}"
        try:
            rows.hint("rebalance", "run_id").write.partitionBy("run_id").parquet(staged)
            there = self.spark.read.schema("run_id string").option("basePath", staged).parquet(staged)
            counts = there.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(attempt).alias("attempt"), "n")
            counts.coalesce(1).write.parquet(f"{self.folder}/manifest/{attempt}")
        except BaseException:
            self.withdraw(attempt)
            raise
        return attempt

    def _rows(self) -> DataFrame:
        """All staged rows, with run_id and attempt as texts, whatever they look like."""
        found = self.spark.read.parquet(f"{self.folder}/rows").schema
        texts = [StructField(f.name, StringType() if f.name in ("run_id", "attempt") else f.dataType) for f in found]
        return self.spark.read.schema(StructType(texts)).parquet(f"{self.folder}/rows")

    def read(self) -> DataFrame:
        """All published runs."""
        return self._rows().join(self.manifest().select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").drop("attempt")

    def read_run(self, run_id: str) -> DataFrame:
        """One published run; its partition is the only one that is read."""
        told = self.manifest().where(F.col("run_id") == run_id).collect()
        if not told:
            raise RunMissing("the run isn't published", run_id=run_id)
        return self._rows().where((F.col("run_id") == run_id) & (F.col("attempt") == told[0].attempt)).drop("attempt")
