"""Writers: partitioned parquet, dated sets, CSV and JSON reports, status logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_projects(df: DataFrame, path: str) -> None:
    """Replace only the partitions of the projects in ``df``; the committer makes each replacement atomic."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_name").parquet(path)


def write_dated(df: DataFrame, directory: str, stamp: str) -> str | None:
    """A new dated data set; nothing is written for an empty frame."""
    if df.isEmpty():
        return None
    path = f"{directory}/ts={stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    """A report of bounded size as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_status(df: DataFrame, path: str) -> None:
    """Append (name, status, completed_at) rows to a status log."""
    df.write.mode("append").parquet(path)


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each name in a log."""
    log = spark.read.parquet(path)
    return log.groupBy("name").agg(F.max_by(F.struct(*[c for c in log.columns if c != "name"]), "completed_at").alias("last")).select("name", "last.*")


def merged_results(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New results overwrite old ones of the same key."""
    o, n = old.select(F.col(key), F.col(value).alias("o_")), new.select(F.col(key), F.col(value).alias("n_"))
    return o.join(n, key, "full").select(key, F.coalesce("n_", "o_").alias(value))
