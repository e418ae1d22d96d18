"""Queries about abusive content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.llm import abuse
from murmuro.session import table


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The abuse score of every row of ``train``."""
    found = abuse.scored(table(spark, folder, "train"), table(spark, folder, "train_labels"), "train_id", "text", "abusive")
    return found.select(F.col("row_id").alias("train_id"), "score", "abusive")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Abusive rows of ``train``."""
    return p6_scores(spark, folder).where("abusive").select("train_id")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of abusive rows per source."""
    source = table(spark, folder, "train").select("train_id", F.col("source").alias("from_source"))
    return abuse.rates(p6_scores(spark, folder).join(source, "train_id"), F.col("from_source"))


QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores, "p6_rates": p6_rates}
ORACLE: dict = {}
