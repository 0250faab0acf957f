"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bsi_topk, centroids, conversation_trie, mixing, warc
from gaugeline.llm._common import read_table


def op1_bsi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bsi_topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm import quality_rules as q

    docs = read_table(spark, sf_dir, "documents")
    rules = q.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    return q.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 8).alias("first_position"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.bpe_codec import digests

    return digests(read_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.simhash import components

    found = components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm import pii

    return pii.find(read_table(spark, sf_dir, "documents"), *pii.train(spark))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.substring_dedup import dedup

    return dedup(read_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.piece_codec import digests

    return digests(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bsi_topk": op1_bsi_topk,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroids": op11_centroids,
    "op12_piece_codec": op12_piece_codec,
    "op13_conversation_trie": op13_conversation_trie,
}

#: DuckDB SQL with the same rows and columns, where SQL can express the query.
ORACLE_SQL: dict[str, str] = {
    "op1_bsi_topk": bsi_topk.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
