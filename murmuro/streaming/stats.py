"""Running counters of a message stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuro.functions import text


def observed(messages: DataFrame, name: str = "messages") -> DataFrame:
    """``messages``, batch or stream, with counters that listeners get per batch: rows, without text, filtered, valid."""
    empty = F.col("text").isNull() | (F.col("text") == "")
    valid = text.valid_in_batch(F.col("text"))
    return messages.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("no_text"), F.count_if(~empty & ~valid).alias("filtered"), F.count_if(valid).alias("valid"))
