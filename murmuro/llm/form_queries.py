"""Queries over the form of texts: unusual characters and format duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuro.llm import format_duplicates, lookalikes
from murmuro.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``train`` that hold other characters than they seem to."""
    hidden = F.arrays_overlap("kinds", F.array(*map(F.lit, lookalikes.HIDDEN_KINDS)))
    return lookalikes.examine(table(spark, folder, "train"), "train_id", "text").where(hidden).select(F.col("row_id").alias("train_id"))


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of ``train`` in one consistent form, with the kinds of finding."""
    return lookalikes.examine(table(spark, folder, "train"), "train_id", "text").select(F.col("row_id").alias("train_id"), "unified", "kinds")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members of groups of format duplicates but the first of each."""
    return format_duplicates.copies(table(spark, folder, "train"), "train_id", "text").select(F.col("first_id").alias("train_id"), "copy_id")


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of ``train`` once, with the number of its copies."""
    return format_duplicates.collapsed(table(spark, folder, "train"), "train_id", "text").select(F.col("row_id").alias("train_id"), "copies")


QUERIES = {"p5_found": p5_found, "p5_unified": p5_unified, "p7_found": p7_found, "p7_records": p7_records}

_LATIN, _REST = r"\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02AF}", r"\x{0370}-\x{0373}\x{0376}-\x{03FF}\x{0400}-\x{0481}\x{048A}-\x{052F}"
_GREEK, _CYRILLIC = r"\x{0370}-\x{0373}\x{0376}-\x{03FF}", r"\x{0400}-\x{0481}\x{048A}-\x{052F}"
_GLUE = r"[\x{0300}-\x{036F}0-9]*"
_HIDDEN = r"\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}"
_PICTURES = r"\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2900}-\x{297F}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}"
_IGNORED = r"[\s\pP\p{Sm}\p{Sk}\p{Sc}\p{Cc}\pZ]+"
#: Fields are what stands between separators here, and not what a pattern finds.
_SAME_SQL = rf"""
WITH t AS (SELECT train_id, replace(upper(text), 'ß', 'SS') AS u FROM train WHERE text IS NOT NULL),
cut AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(u, '["''{{}}]', '', 'g'), '\s+([\pL_][\pL\pN_]*\s*=)', ';\1', 'g'), '[;|,\n]+'), lambda x: regexp_replace(x, '^[\s\pP]+|[\s\pP]+$', '', 'g')), lambda x: x <> '') AS parts FROM t),
keyed AS (SELECT train_id, CASE
  WHEN len(parts) >= 2 AND list_bool_and(list_transform(parts, lambda x: regexp_full_match(x, '[\pL_][\pL\pN_]*\s*[:=][^:=]*(?:[0-9]:[0-9][^:=]*)*')))
  THEN 'r' || array_to_string(list_sort(list_transform(parts, lambda x: regexp_replace(x, '\s*[:=][\s\pP]*', '='))), chr(10))
  ELSE 't' || regexp_replace(u, '{_IGNORED}', '', 'g') END AS k FROM cut),
ranked AS (SELECT train_id, min(train_id) OVER (PARTITION BY k) AS first_id, count(*) OVER (PARTITION BY k) AS n FROM keyed)
"""
ORACLE = {
    "p5_found": f"""
WITH t AS (
  SELECT train_id, regexp_replace(regexp_replace(text, '[{_PICTURES}]\\x{{FE0F}}', '❤', 'g'), '[{_PICTURES}]\\x{{200D}}', '❤', 'g') AS a FROM train WHERE text IS NOT NULL
), u AS (SELECT train_id, a, regexp_replace(a, '[{_HIDDEN}\\x{{200D}}]', '', 'g') AS b FROM t)
SELECT train_id FROM u WHERE a <> b
  OR regexp_matches(a, '[\\x{{FF10}}-\\x{{FF19}}\\x{{FF21}}-\\x{{FF3A}}\\x{{FF41}}-\\x{{FF5A}}\\x{{FB00}}-\\x{{FB06}}\\x{{FB13}}-\\x{{FB17}}\\x{{0132}}\\x{{0133}}\\x{{01C4}}-\\x{{01CC}}\\x{{01F1}}-\\x{{01F3}}]')
  OR regexp_matches(a, '[\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')
  OR regexp_matches(a, '\\pL[\\x{{0300}}-\\x{{036F}}\\x{{0483}}-\\x{{0487}}\\x{{3099}}\\x{{309A}}]')
  OR regexp_matches(b, '[{_LATIN}]{_GLUE}[{_REST}]|[{_REST}]{_GLUE}[{_LATIN}]|[{_GREEK}]{_GLUE}[{_CYRILLIC}]|[{_CYRILLIC}]{_GLUE}[{_GREEK}]')""",
    "p7_found": _SAME_SQL + "SELECT first_id AS train_id, train_id AS copy_id FROM ranked WHERE train_id <> first_id",
    "p7_records": _SAME_SQL + "SELECT train_id, n AS copies FROM ranked WHERE train_id = first_id UNION ALL SELECT train_id, 1 FROM train WHERE text IS NULL",
}
