"""Queries of the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.llm import residue, subjects
from forgelens.session import table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text", "source")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with template residue, filler, error pages or script notices."""
    return residue.residue(_documents(spark, sf)).select("doc_id")


def p10_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The masked residue messages, with the documents and sources they are residue in."""
    return residue.recurrence(_documents(spark, sf))


def _discovery(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "discovery", "full_name", "topics", "description"), table(spark, sf, "category_labels", "full_name", "category"), table(spark, sf, "category_catalog", "category", "meaning")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The one or two subject areas of every project found."""
    return subjects.subjects(*_discovery(spark, sf))


def p5_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Projects and share per subject; a project with two subjects counts half for each."""
    found = p5_found(spark, sf)
    weight = found.groupBy("full_name").agg(F.collect_list("category").alias("cs")).select(F.explode("cs").alias("category"), (1 / F.size("cs")).alias("w"))
    by = weight.groupBy("category").agg(F.count("*").alias("projects"), F.sum("w").alias("weight"))
    total = by.agg(F.sum("weight").alias("total"))
    return by.join(F.broadcast(total)).select("category", "projects", F.round(F.col("weight") / F.col("total"), 6).alias("share"))


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Top terms of every topic, to inspect that it means its subject."""
    return subjects.top_terms(*_discovery(spark, sf))


QUERIES = {"p5_found": p5_found, "p5_composition": p5_composition, "p5_terms": p5_terms, "p10_found": p10_found, "p10_messages": p10_messages}
ORACLES: dict[str, str] = {}
