"""Character n-gram counts: one window per position, counted once, rolled up to all orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOF, ESC = "\u0002", "\u0003", "\u0004"
ORDER = 11


#: Characters of the parts that a text is cut into, first long ones and then short ones: a place in a part is found by counting from its start.
PARTS = (4096, 64)


def windows(texts: DataFrame, text: str = "text", order: int = ORDER, weight: Column | None = None) -> DataFrame:
    """``(window, cnt)``: every position with the ``order`` symbols before it, padded at the start and closed by EOF.

    A text is cut into short overlapping parts and every window is a substring
    of its part, which stays in generated code and is linear in the length of
    the text. Null texts are left out. A ``weight`` counts a row several times
    without replicating it.
    """
    padded = F.concat(F.lit(BOS * order), F.col(text), F.lit(EOF))
    rows = texts.where(F.col(text).isNotNull()).select(padded.alias("part"), (weight if weight is not None else F.lit(1)).cast("bigint").alias("w"))
    for size in PARTS:
        most = F.lit(size + order)
        cuts = F.transform(F.sequence(F.lit(1), F.length("part") - order, F.lit(size)), lambda i: F.substr(F.col("part"), i, most))  # noqa: B023
        rows = rows.select("w", F.explode(cuts).alias("part"))
    spots = rows.select("w", "part", F.explode(F.sequence(F.lit(1), F.length("part") - order)).alias("i"))
    return spots.select("w", F.substr(F.col("part"), F.col("i"), F.lit(order + 1)).alias("window")).groupBy("window").agg(F.sum("w").alias("cnt"))


def rolled_up(counted: DataFrame, order: int = ORDER, orders: tuple[int, int] | None = None) -> DataFrame:
    """``(n, ctx, ch, cnt)`` for all orders up to ``order``, or for those from the first to the last of ``orders``, from counted windows of ``order``."""
    low, high = orders or (0, order)
    each = counted.select("cnt", "window", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n"))
    ctx = F.substr(F.col("window"), F.lit(order + 1) - F.col("n"), F.col("n"))
    return each.groupBy("n", ctx.alias("ctx"), F.substr(F.col("window"), F.lit(order + 1), F.lit(1)).alias("ch")).agg(F.sum("cnt").alias("cnt"))


def frequent(counted: DataFrame, least: int, whole: int, order: int = ORDER, steps: tuple[int, ...] = (4, 7)) -> DataFrame:
    """``(n, ctx, ch, cnt)`` of the contexts seen ``least`` times, and of all below order ``whole``, from counted windows.

    A context is seen no more often than any of its ends. So after each of
    ``steps`` only windows go on whose context of that order is frequent.
    """
    out, alive, low = None, counted, 0
    for high in [*(k for k in steps if whole <= k < order), order]:
        part = pruned(rolled_up(alive, order, (low, high)), least, whole)
        out = part if out is None else out.unionByName(part)
        if high < order:
            ctx = F.substring("window", order + 1 - high, high)
            kept = alive.groupBy(ctx.alias("ctx")).agg(F.sum("cnt").alias("total")).where(F.col("total") >= least).select("ctx")
            alive = alive.join(kept, ctx == kept["ctx"], "left_semi")
        low = high + 1
    return out


def counts(texts: DataFrame, text: str = "text", order: int = ORDER, weight: Column | None = None) -> DataFrame:
    return rolled_up(windows(texts, text, order, weight), order)


def totals(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n", "ctx").agg(F.sum("cnt").alias("total"))


def pruned(counted: DataFrame, threshold: int, keep_below: int = 3) -> DataFrame:
    """Without contexts of order ``keep_below`` and up that were seen less than ``threshold`` times."""
    if threshold <= 1:
        return counted
    kept = totals(counted).where((F.col("n") < keep_below) | (F.col("total") >= threshold)).select("n", "ctx")
    return counted.join(kept, ["n", "ctx"], "left_semi")


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(idx, ch)``: the symbols in code point order, numbered from 0. The alphabet is bounded by Unicode."""
    symbols = texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("ch")).distinct()
    special = texts.sparkSession.createDataFrame([(EOF,), (ESC,)], "ch STRING")
    every = symbols.union(special).distinct().agg(F.array_sort(F.collect_set("ch")).alias("all"))
    return every.select(F.posexplode("all").alias("idx", "ch"))


def as_json(counted: DataFrame) -> DataFrame:
    """``(n, ctx, json)``: of every context its place in the portable model, ``{"symbol": count, ...}``. No row holds more than one context."""
    pairs = F.concat_ws(",", F.array_sort(F.collect_list(F.concat(F.to_json(F.array("ch")).substr(F.lit(2), F.length(F.to_json(F.array("ch"))) - 2), F.lit(":"), F.col("cnt").cast("string")))))
    return counted.groupBy("n", "ctx").agg(F.concat(F.lit("{"), pairs, F.lit("}")).alias("json"))


def from_json(document: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Counts ``(n, ctx, ch, cnt)`` and the vocabulary ``(idx, ch)`` of portable models; the end and escape signs are added where they lack."""
    parsed = document.select(F.from_json(json, "o INT, v ARRAY<STRING>, c ARRAY<MAP<STRING, MAP<STRING, BIGINT>>>").alias("m"))
    each = parsed.select(F.col("m.o").alias("o"), F.posexplode("m.c").alias("n", "by")).where("n <= o").select("n", F.explode("by").alias("ctx", "next"))
    symbols = F.array_sort(F.array_distinct(F.concat("m.v", F.array(F.lit(EOF), F.lit(ESC)))))
    return each.select("n", "ctx", F.explode("next").alias("ch", "cnt")), parsed.select(F.posexplode(symbols).alias("idx", "ch"))
