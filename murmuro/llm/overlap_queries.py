"""Queries about text that stands in two places: splits, and evaluation items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.llm import leaked_passages, shared_spans
from murmuro.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a test and a train row with the same message."""
    return shared_spans.overlaps(table(spark, folder, "test"), table(spark, folder, "train"), "test_id", "train_id")


def p1_by_split_and_source(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping test rows and pairs per split of the test row and source of the train row."""
    split = table(spark, folder, "test").select("test_id", "split_name")
    source = table(spark, folder, "train").select("train_id", "source")
    joined = p1_found(spark, folder).join(split, "test_id").join(source, "train_id")
    return joined.groupBy("split_name", "source").agg(F.count("*").alias("pairs"), F.countDistinct("test_id").alias("test_rows"))


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """For each overlapping row of ``test``: its words, how many of them stand in train rows of the same message, and their number."""
    found = shared_spans.pairs(table(spark, folder, "test"), table(spark, folder, "train"), "test_id", "train_id")
    return shared_spans.coverage(found, "test_id", "train_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold thirteen consecutive words of an evaluation item."""
    found = leaked_passages.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "item_id")
    return found.where("distance = 0 AND words >= 13").select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation item that leaked: the documents with it, near ones included, and the longest run of words."""
    found = leaked_passages.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("distance") == 0, 1).otherwise(0)).alias("exact"), F.max("words").alias("longest"))


QUERIES = {"p1_found": p1_found, "p1_by_split_and_source": p1_by_split_and_source, "p1_coverage": p1_coverage, "p9_found": p9_found, "p9_leaked_items": p9_leaked_items}
ORACLE: dict = {}
