"""Queries of the schema-drift operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.operators import schema_drift
from forgelens.session import table


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_snapshots", "record_id", "stream_name", "batch_file", "batch_no", "payload")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a payload field from one file of a stream to the next."""
    return schema_drift.changes(_snapshots(spark, sf)).select("batch_file", "field_name", "change_kind")


def p7_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue: files in a row that hold a field with one type."""
    _, fields = schema_drift.catalogue(schema_drift.observed(_snapshots(spark, sf)))
    return schema_drift.lifespans(fields)


def p7_table(spark: SparkSession, sf: str) -> DataFrame:
    """All readable records as one consistent table."""
    return schema_drift.consistent(_snapshots(spark, sf))


def p7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Readable records per stream and how many name their project: a check on the consistent table."""
    t = p7_table(spark, sf)
    return t.groupBy("stream_name").agg(F.count("*").alias("records"), F.count("full_name").alias("named"))


P7_COVERAGE_SQL = """
select stream_name, count(*) records, count(json_extract_string(payload, '$.full_name')) named
from raw_snapshots where payload is not null and json_valid(payload) and json_type(payload) = 'OBJECT' group by stream_name
"""

QUERIES = {"p7_found": p7_found, "p7_lifespans": p7_lifespans, "p7_table": p7_table, "p7_coverage": p7_coverage}
ORACLES = {"p7_coverage": P7_COVERAGE_SQL}
