"""Queries about the languages of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.llm import languages
from murmuro.session import table

LANGUAGES = ["en", "ru", "de", "fr", "es", "pt", "pl", "uk", "nl", "tr", "ja", "zh"]


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each language segment of every row of ``test`` with its confidence."""
    judge = languages.train(table(spark, folder, "train"), "text", "lang", LANGUAGES)
    return languages.labelled(table(spark, folder, "test"), judge, "test_id", "text").withColumnRenamed("row_id", "test_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``test`` whose label isn't the language of the text, and both languages of mixed rows."""
    given = table(spark, folder, "test").select("test_id", F.col("lang").alias("given"))
    by_row = p3_segments(spark, folder).where("lang IS NOT NULL").groupBy("test_id").agg(F.collect_set("lang").alias("langs"))
    wrong = by_row.join(given, "test_id").where((F.size("langs") > 1) | ~F.col("given").eqNullSafe(F.col("langs")[0]))
    return wrong.select("test_id", F.explode("langs").alias("lang"))


QUERIES = {"p3_found": p3_found, "p3_segments": p3_segments}
ORACLE: dict = {}
