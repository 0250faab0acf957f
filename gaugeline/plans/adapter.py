"""The driver's tables as the engine's relations: one SQL text each, read alike by Spark and by DuckDB.

Quarters of ship dates are runs. Constants are fixed and no clock is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIDEOS = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
         CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS video_id,
  concat('run-', CAST(year(l_shipdate) AS STRING), 'q', CAST(quarter(l_shipdate) AS STRING)) AS run_id,
  concat('year-', CAST(year(l_shipdate) AS STRING)) AS year_id,
  concat('ch-', CAST(l_suppkey AS STRING)) AS channel_id,
  CASE (l_orderkey * 7 + l_linenumber) % 16
    WHEN 0 THEN concat(p_brand, ' x Brand#99 Type Beat')
    WHEN 1 THEN concat('[FREE] ', p_brand, ' Type Beat')
    WHEN 2 THEN p_brand
    WHEN 3 THEN NULL
    WHEN 4 THEN concat('FREE | ', p_brand, ' Type Beat')
    WHEN 5 THEN concat(p_brand, ' Type Beat type beat')
    WHEN 6 THEN 'Free) Type Beat'
    WHEN 7 THEN concat(p_brand, ' 140 bpm Type Beat')
    WHEN 8 THEN ' - '
    ELSE concat(p_brand, ' Type Beat') END AS source_title,
  CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN NULL WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN 0
    ELSE CAST(floor(l_quantity * l_extendedprice / 10) AS BIGINT) END AS views,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(floor(l_extendedprice / 50) AS BIGINT) END AS likes,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS BIGINT) END AS comments,
  CAST(l_shipdate AS TIMESTAMP) AS published_at,
  CAST(date_trunc('quarter', l_shipdate) + INTERVAL '3' MONTH AS TIMESTAMP) AS window_end
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

ARTISTS = "SELECT DISTINCT concat('artist-', substr(p_brand, 7)) AS artist_id, p_brand AS canonical_name FROM {part}"

NAMES = """
SELECT DISTINCT concat('artist-', substr(p_brand, 7)) AS artist_id, p_brand AS name FROM {part}
UNION SELECT DISTINCT concat('artist-', substr(p_brand, 7)), lower(p_brand) FROM {part}
UNION SELECT DISTINCT 'artist-4', 'BRAND 5' FROM {part}
"""

CHANNELS = """
SELECT concat('ch-', CAST(s_suppkey AS STRING)) AS channel_id,
  CASE WHEN s_suppkey % 25 = 3 THEN 'Brand#12' WHEN s_suppkey % 25 = 4 THEN NULL ELSE s_name END AS title,
  CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(floor(s_acctbal) AS BIGINT) END AS subscriber_count
FROM {supplier}
"""

EVENTS = """
SELECT event_id, concat('p-', CAST(user_id AS STRING)) AS producer_id,
  CASE event_type WHEN 'view' THEN 'report_opened' WHEN 'click' THEN 'opportunity_marked_useful' WHEN 'signup' THEN 'intent_to_produce_declared'
    WHEN 'purchase' THEN 'followup_confirmed_produced' ELSE CASE WHEN event_id % 3 = 0 THEN 'wtp_yes' ELSE 'wtp_no' END END AS event_type,
  concat('report-', CAST(event_id % 4 AS STRING)) AS report_id,
  concat('artist-', CAST(event_id % 25 AS STRING)) AS artist_id,
  CASE WHEN event_id % 5 < 2 THEN 'HOT' END AS tag,
  CAST(ts AS TIMESTAMP) AS created_at
FROM {events}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "pages", "documents")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation in Spark: only the tables that its text names are opened."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **named)


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql
