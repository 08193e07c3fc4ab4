"""Queries of the source-file operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.llm import grammar, handwritten
from forgelens.session import table


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files", "file_id", "project_name", "file_path", "content")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are not hand-written source of their project."""
    return handwritten.not_handwritten(_files(spark, sf)).select("file_id")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Files per reason and extension; the remainder is hand-written."""
    files = _files(spark, sf)
    found = handwritten.not_handwritten(files)
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    kept = files.select("file_id", ext.alias("extension")).where("extension in ('py', 'js')").join(found, "file_id", "left")
    return kept.groupBy("extension", F.coalesce("reason", F.lit("hand-written")).alias("reason")).agg(F.count("*").alias("files"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Files that break the grammar their extension names."""
    return grammar.flagged(_files(spark, sf))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged files per repository and language."""
    return grammar.rates(_files(spark, sf))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p3_found": p3_found, "p3_rates": p3_rates}
ORACLES: dict[str, str] = {}
