"""Queries about filling containers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.llm import packing
from murmuro.session import table


def _vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary; ``MURMURO_TOKENIZER`` names another file."""
    import public_tokenizers

    return os.environ.get("MURMURO_TOKENIZER") or str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every piece of every document and the room left in it."""
    return packing.packed(table(spark, folder, "documents"), "doc_id", "text", *_vocabulary())


def p8_room(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of unused room."""
    boxes = p8_containers(spark, folder).where("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("used"), F.max("room").alias("room"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("room") / F.sum(F.col("used") + F.col("room"))).alias("unused"))


QUERIES = {"p8_containers": p8_containers, "p8_room": p8_room}
ORACLE: dict = {}
