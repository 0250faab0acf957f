"""From raw documents to encoded training text: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Its result is written as Parquet, and the
next stage reads that. All but the last return the columns of documents.

Defined results: a null or empty text has no words, so the first stage rejects it; later stages, by themselves, keep
null texts as they are, mix them as of size 0, which no pass takes, and encode them as empty. Repeated rows go on as one
after near-duplicates. Empty tables give empty tables, and without usable labels only the base rule rejects. Extra
columns are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe_codec, mixing, pii, quality_rules, simhash_near
from gaugeline.llm._common import read_table, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the learned decision list or the base rule rejects."""
    rules = quality_rules.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more."""
    return simhash_near.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the name of its kind in the place of each span of personal data."""
    done = pii.redacted(docs, *pii.train(spark))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target takes them, in training order."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and the text that they decode to."""
    coded = bpe_codec.round_trip(docs)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("encoding", encode),
]

#: The learned rules, the shingle hashes and the token ids can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, folder = read_table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
