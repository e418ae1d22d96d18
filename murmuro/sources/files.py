"""Files in and out: JSON lines, plain lines, files keyed by language, archives, logs, models."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.functions.text import strip
from murmuro.operators import ngram

MESSAGE = "text STRING, lang STRING, source STRING"
LOG = "commit STRING, avg_bpc DOUBLE, roundtrip DOUBLE, time_s DOUBLE, status STRING, description STRING"
#: All line ends that Unicode knows.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def json_lines(spark: SparkSession, path: str, schema: str = MESSAGE, *, missing_ok: bool = False, archive: str | None = None) -> DataFrame:
    """Records of JSON lines; malformed and blank lines are dropped.

    A missing file is an error, or empty with ``missing_ok``, or read from
    ``archive``: a zip whose member has the same file name.
    """
    if not _exists(spark, path):
        if archive is not None:
            return from_archive(spark, archive, path.rsplit("/", 1)[-1], schema)
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def from_archive(spark: SparkSession, archive: str, member: str, schema: str = MESSAGE) -> DataFrame:
    """JSON lines of one member of zip files; each archive is one task, as zip can't be split."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as held:
                    for name in held.namelist():
                        if name.rsplit("/", 1)[-1] == member:
                            yield pd.DataFrame({"value": [line for line in held.read(name).decode().split("\n") if line.strip()]})

    lines = spark.read.format("binaryFile").load(archive).select("content").mapInPandas(unpack, "value STRING")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL").select("r.*")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(text, file)``: stripped non-blank lines, ended by any Unicode line end."""
    whole = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return whole.select(F.explode(F.split("value", LINE_END)).alias("text"), "file").select(strip(F.col("text")), "file").where("text <> ''")


def by_language(spark: SparkSession, folder: str) -> DataFrame:
    """``(text, lang, part)`` of files ``train_xx.txt`` and ``test_xx.txt``; the files of all languages together are left out."""
    named = lines(spark, f"{folder}/*_*.txt").select("text", F.regexp_extract("file", r"^(train|test)_(.+)\.txt$", 2).alias("lang"), F.regexp_extract("file", r"^(train|test)_", 1).alias("part"))
    return named.where("lang <> '' AND lang <> 'all'")


def collected(spark: SparkSession, folder: str) -> DataFrame:
    """``(text, lang)`` of files ``xx.jsonl``; files whose name begins with an underscore are no language."""
    rows = spark.read.schema("text STRING").option("mode", "DROPMALFORMED").json(f"{folder}/*.jsonl")
    return rows.select("text", F.regexp_extract(F.col("_metadata.file_name"), r"^([^_].*)\.jsonl$", 1).alias("lang")).where("lang <> ''")


def experiments(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated log of experiments with a header."""
    return spark.read.schema(LOG).option("sep", "\t").option("header", True).csv(path)


def write_json_lines(rows: DataFrame, path: str, *by: str) -> None:
    """JSON lines, one folder per value of ``by``."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def append_json_lines(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).json(path)


def write_model(counted: DataFrame, path: str, threshold: int = 1) -> None:
    """Counts as Parquet, a folder per order."""
    ngram.pruned(counted, threshold).write.mode("overwrite").partitionBy("n").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ctx STRING, ch STRING, cnt BIGINT, n INT").parquet(path).select("n", "ctx", "ch", "cnt")


def write_portable_model(counted: DataFrame, vocabulary: DataFrame, path: str, threshold: int = 5, order: int = ngram.ORDER) -> None:
    """The portable JSON model in a local file, ``{"o": order, "v": [symbols], "c": [{context: {symbol: count}} for each order]}``; pruned first.

    Contexts come to the driver one partition at a time and leave for the file at once.
    """
    rows = ngram.as_json(ngram.pruned(counted, threshold).where(F.col("n") <= order)).orderBy("n", "ctx")
    dumped = partial(json.dumps, ensure_ascii=False, separators=(",", ":"))
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'{{"o":{order},"v":{dumped([r["ch"] for r in vocabulary.orderBy("idx").select("ch").toLocalIterator()])},"c":[')
        n, first = 0, True
        out.write("{")
        for r in rows.toLocalIterator():
            while n < r["n"]:
                out.write("},{")
                n, first = n + 1, True
            out.write(("" if first else ",") + f'{dumped(r["ctx"])}:{r["json"]}')
            first = False
        out.write("},{" * (order - n) + "}]}")


def read_portable_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Counts and vocabulary of a portable JSON model; a whole file is one document."""
    return ngram.from_json(spark.read.option("wholetext", True).text(path), "value")


def write_splits(rows: DataFrame, folder: str) -> None:
    """Text files of ``(text, lang, part)`` rows in folders ``part=.../lang=...``; line ends in a text become blanks."""
    line = F.regexp_replace("text", LINE_END, " ").alias("value")
    rows.where("text IS NOT NULL AND lang IS NOT NULL").select(line, "lang", "part").write.mode("overwrite").partitionBy("part", "lang").text(folder)


def append_stream(messages: DataFrame, folder: str, checkpoint: str):
    """A stream of messages appended to JSON lines in a folder per language; the query, which the caller stops. Each row is written once."""
    return messages.writeStream.format("json").partitionBy("lang").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()
