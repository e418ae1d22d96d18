"""Queries about documents without content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuro.llm import template_residue
from murmuro.session import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose content is missing or was never filled in."""
    return template_residue.residue(table(spark, folder, "documents"), "doc_id").select("doc_id")


def p10_content(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with content, and their length."""
    documents = table(spark, folder, "documents")
    return documents.where("text IS NOT NULL").join(template_residue.residue(documents, "doc_id").select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_chars")


QUERIES = {"p10_found": p10_found, "p10_content": p10_content}
ORACLE: dict = {}
