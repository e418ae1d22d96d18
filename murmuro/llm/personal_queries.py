"""Queries about personal items in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.llm import personal
from murmuro.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every personal item of ``train`` with its kind and first character."""
    found = personal.items(table(spark, folder, "train"), table(spark, folder, "given_names"), "train_id", "text", "given_name")
    return found.select(F.col("row_id").alias("train_id"), "kind", "start_pos")


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of ``train`` with a typed placeholder for each item."""
    found = personal.masked(table(spark, folder, "train"), table(spark, folder, "given_names"), "train_id", "text", "given_name")
    return found.select(F.col("row_id").alias("train_id"), "masked", "items")


QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
ORACLE: dict = {}
