"""Queries of the redelivery operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.streaming import redelivery


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every surplus row of ``raw_messages``."""
    log = redelivery.verdicts(spark, f"{folder}/raw_messages.parquet")
    return redelivery.surplus(log).select(F.col("key").alias("packet_id"), "id")


def p2_messages(spark: SparkSession, folder: str) -> DataFrame:
    """``raw_messages`` with one row per message."""
    return redelivery.messages_once(spark, f"{folder}/raw_messages.parquet").select("id", "packet_id", "created_at", "batch_no")


QUERIES = {"p2_found": p2_found, "p2_messages": p2_messages}

_RANKED = """
WITH spelled AS (
  SELECT *, regexp_replace(packet_id, '\\s', '', 'g') AS bare, trim(created_at) AS written FROM raw_messages
), parsed AS (
  SELECT *, CASE WHEN regexp_full_match(bare, '\\+?[0-9]+(\\.0*)?') THEN CAST(CAST(bare AS DECIMAL(38,6)) AS BIGINT) END AS packet_no,
    CASE WHEN regexp_matches(written, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN CAST(written AS TIMESTAMPTZ)
         ELSE CAST(written || '+00' AS TIMESTAMPTZ) END AS at_instant
  FROM spelled
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY packet_no ORDER BY at_instant NULLS LAST, CAST(id AS BIGINT)) AS rn FROM parsed
)
"""
ORACLE = {
    "p2_found": _RANKED + "SELECT packet_no AS packet_id, id FROM ranked WHERE packet_no IS NOT NULL AND rn > 1",
    "p2_messages": _RANKED + "SELECT id, packet_id, created_at, batch_no FROM ranked WHERE packet_no IS NULL OR rn = 1",
}
