"""Records that differ only in format, by progressive partition refinement.

1. A cheap invariant splits all rows: the length of the text stripped of case,
   blanks and punctuation, and a hash of its letter histogram. Both survive
   reordered fields and every notation of a record, so equal records always
   share a class. Only ids and the invariant are shuffled, counted map-side.
2. Only members of classes with several members have their exact key built:
   the sorted ``name=value`` pairs of a record of named fields, or the stripped
   text. The key leaves as a 128-bit hash beside the invariant.
3. Equal keys form a group: one aggregate row per group, joined back to its
   members, so a hot group is split by adaptive skew handling and is never
   gathered.

Null texts belong to no group. Texts that strip to nothing (blank, punctuation
only) are equal to each other. Columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuro.session import stored

#: What format may change: blanks, punctuation, mathematical and modifier signs, controls. Emoji (So), joiners and marks stay.
IGNORED = r"(?U)[\s\p{P}\p{Sm}\p{Sk}\p{Sc}\p{Cc}]+"
#: A field: a name, a sign and a value of any length. A value ends where the next field begins or the text ends; every
#: alternative is tried once per place, so texts of any form are read in linear time and without recursion.
_NAME = r"[\"']?(?<![\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]*+)[\"']?"
_NEXT = r"(?<![;|,\s{}])[;|,\s{}]++[\"']?[\p{L}_][\p{L}\p{N}_]*+[\"']?[ \t]*+[:=]"
FIELD = rf"(?U){_NAME}[ \t]*+[:=][ \t]*+(\"[^\"\n]*+\"(?=[ \t]*+[;|,\n{{}}]|$)|'[^'\n]*+'(?=[ \t]*+[;|,\n{{}}]|$)|[^=:]*?(?={_NEXT}|$))"


def bare(text: Column) -> Column:
    """``text`` without letter case, blanks and punctuation. Upper case folds sharp s and dotless i alike."""
    return F.regexp_replace(F.upper(text), IGNORED, "")


def record_key(text: Column) -> Column:
    """The sorted fields of a record of at least two named fields that spans the whole text, else null.

    Values may hold any words and signs; an unquoted one holds no ``=``, and a colon only between numbers.
    """
    clocks = F.regexp_replace(F.upper(text), r"(?U)(?<![\p{L}\p{N}_])([0-9]++):(?=[0-9])", "$1∶")  # a colon between numbers belongs to the value
    line = F.regexp_extract(clocks, r"(?Us)^(.*[^\s\p{P}][\"']?)", 1)
    names, values = (F.regexp_extract_all(line, F.lit(FIELD), F.lit(i)) for i in (1, 2))
    trimmed = F.transform(values, lambda v: F.regexp_replace(v, r"(?U)^[\s\p{P}]++|(?<![\s\p{P}])[\s\p{P}]++$", ""))
    fields = F.array_sort(F.zip_with(names, trimmed, lambda n, v: F.concat(n, F.lit("="), v)))
    rest = F.regexp_replace(F.regexp_replace(line, FIELD, ""), IGNORED, "")
    return F.when(clocks.rlike("[:=]") & (F.size(names) >= 2) & (rest == ""), F.concat_ws("\n", fields))


def groups(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row_id, first_id, copies)`` for every member of a group of two or more equal records."""
    rows = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).where("text IS NOT NULL AND row_id IS NOT NULL")
    stripped = bare(F.col("text"))
    marks = stored(
        rows.select("row_id", stripped.alias("s")).select("row_id", F.length("s").alias("size"), F.xxhash64(F.array_join(F.array_sort(F.split("s", "")), "")).alias("letters")),
        "format-invariants",
    )
    crowded = marks.groupBy("size", "letters").agg(F.count("*").alias("n")).where("n > 1").select("size", "letters")
    members = marks.join(crowded, ["size", "letters"], "left_semi")
    exact = F.coalesce(F.concat(F.lit("record\n"), record_key(F.col("text"))), F.concat(F.lit("text\n"), stripped))
    keyed = stored(rows.join(members, "row_id").select("row_id", "size", "letters", F.unhex(F.md5(exact)).alias("key")), "format-keys")
    found = keyed.groupBy("size", "letters", "key").agg(F.min("row_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(found, ["size", "letters", "key"]).select("row_id", "first_id", "copies")


def copies(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """Every member but the first of each group: ``(first_id, copy_id)``."""
    return groups(rows, row_id, text).where("row_id <> first_id").select("first_id", F.col("row_id").alias("copy_id"))


def collapsed(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per record with the number of its copies: ``(row_id, copies)``; rows of null text count once each."""
    found = groups(rows, row_id, text)
    lone = rows.select(F.col(row_id).alias("row_id")).join(found.where("row_id <> first_id").select("row_id"), "row_id", "left_anti")
    return lone.join(found.where("row_id = first_id").select("row_id", "copies"), "row_id", "left").select("row_id", F.coalesce("copies", F.lit(1)).alias("copies"))
