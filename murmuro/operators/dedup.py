"""Duplicates in order, by one key, by two keys, and within a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the order of ``order``; one aggregate per key, no window over a hot group."""
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("__row"))
    return kept.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])


def two_keys(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The first row per non-blank ``key``, and of these the first per text; a row that loses on ``key`` never claims its text."""
    named = F.col(key).isNotNull() & (F.col(key) != "")
    staged = rows.withColumn("__key", F.when(named, F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("o"), F.col(order).cast("string"))))
    once = first_by(staged, ["__key"], order).drop("__key")
    return first_by(once.withColumn("__text", F.md5(F.coalesce(text, F.lit("")))), ["__text"], order).drop("__text")


def stored_in_window(instants: Column, window: int) -> Column:
    """Of the ascending epoch seconds of one text, those that are stored: each at least ``window`` after the last stored one."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(instants, empty, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.get(kept, F.size(kept) - 1) >= window), F.array_append(kept, t)).otherwise(kept))
