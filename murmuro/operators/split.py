"""Train and test splits that are deterministic and leak nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_TEST, REAL_NEEDED = 500, 20


BUCKET = 4  # hexadecimal digits of a digest that name a bucket: 65,536 of them


def _leading(rows: DataFrame, group: list[str], want: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``__first``: whether a row is among the first ``__want`` of its group, by digest of its text and then by id.

    Rows are counted by group and bucket; the bucket in which the wanted number
    is reached is the only one whose rows are ranked, so no group is gathered.
    Groups without a row in ``want`` have none.
    """
    hashed = rows.withColumn("__digest", F.md5(F.concat_ws("|", F.lit(str(seed)), "text"))).withColumn("__bucket", F.substring("__digest", 1, BUCKET))
    counted = hashed.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most 65,536 rows a group
    same = [counted[g].eqNullSafe(want[g]) for g in group]
    reached = counted.join(want, same).select(*[counted[g] for g in group], "__bucket", "__n", "__want").withColumn("__upto", upto).where("__upto - __n < __want")
    edge = reached.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.max(F.struct("__bucket", (F.col("__want") - F.col("__upto") + F.col("__n")).alias("need"))).alias("__edge"))
    joined = hashed.join(edge, [hashed[g].eqNullSafe(edge[f"__{g}"]) for g in group], "left")
    at = F.col("__bucket") == F.col("__edge.__bucket")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__digest", "id"))
    ranked = joined.where(at).withColumn("__first", rank <= F.col("__edge.need"))
    clear = joined.where(~F.coalesce(at, F.lit(False))).withColumn("__first", F.coalesce(F.col("__bucket") < F.col("__edge.__bucket"), F.lit(False)))
    return clear.unionByName(ranked).select(*rows.columns, "__first")


def top_n(rows: DataFrame, seed: int = 42) -> DataFrame:
    """``part`` (test or train) per language: a tenth of the pool, 50 to 500 rows, of real rows if there are 20, else of synthetic ones.

    ``rows``: id, text, lang, source. The order is that of a digest.
    """
    pools = rows.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("source") == "real").alias("real"))
    want = pools.select("lang", F.when(F.col("real") >= REAL_NEEDED, "real").otherwise("synthetic").alias("source"), F.least(F.lit(MOST_TEST), F.greatest(F.lit(50), F.floor(F.col("total") / 10))).alias("__want"))
    marked = _leading(rows, ["lang", "source"], want, seed)
    return marked.withColumn("part", F.when(F.col("__first"), "test").otherwise("train")).drop("__first")


def nine_to_one(rows: DataFrame, least: int = 1, seed: int = 42) -> DataFrame:
    """``part`` per language: the first nine tenths by digest, at least ``least`` rows, are train."""
    want = rows.groupBy("lang").agg(F.greatest(F.lit(least), F.floor(F.count("*") * 9 / 10)).alias("__want"))
    return _leading(rows, ["lang"], want, seed).withColumn("part", F.when(F.col("__first"), "train").otherwise("test")).drop("__first")


def without_leaks(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Train rows whose text is in no test row."""
    return train.join(test.select(text).distinct(), text, "left_anti").select(train.columns)
