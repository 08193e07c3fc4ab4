"""Registration of queries with their SQL, and the bindings of tables to roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.operators import history
from forgelens.session import table

AS_OF = 1_743_465_600  # 2025-04-01, the end of the month the tables lie in
AS_OF_DATE = "2025-04-01"


class Book:
    """Queries and SQL of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f
        return add


def touches(spark: SparkSession, sf: str) -> DataFrame:
    """File touches bound from order lines: project = brand, path = part, commit = order, author = customer."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_returnflag")
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = table(spark, sf, "part", "p_partkey", "p_brand")
    subject = (
        F.when(F.col("o_orderpriority").startswith("1"), "fix: crash error in parser").when(F.col("o_orderpriority").startswith("2"), "refactor parser")
        .when(F.col("o_orderpriority").startswith("3"), 'Revert "add feature"').when(F.col("o_orderpriority").startswith("4"), "add feature").otherwise("resolve issue #12")
    )
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("project"), F.col("l_partkey").alias("path"), F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), subject.alias("subject"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("added"), F.col("l_linenumber").cast("double").alias("deleted"),
    )


TOUCHES_SQL = """touches as (select p_brand project, l_partkey path, o_orderkey sha, o_custkey author, cast(floor(epoch(o_orderdate)) as bigint) ts,
 case when o_orderpriority like '1%' then 'fix: crash error in parser' when o_orderpriority like '2%' then 'refactor parser'
 when o_orderpriority like '3%' then 'Revert "add feature"' when o_orderpriority like '4%' then 'add feature' else 'resolve issue #12' end subject,
 case when l_returnflag <> 'N' then l_quantity end added, cast(l_linenumber as double) deleted
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""
TOUCHES_AS_OF = 946_684_800  # a moment after most order dates


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """The commit log: (commit_row_id, repo, sha, author, ts, subject) with numeric seconds where readable."""
    c = table(spark, sf, "commit_log", "commit_row_id", "project_name", "sha", "author", "ts", "subject")
    return history.parsed_commits(c).select("commit_row_id", F.col("project_name").alias("repo"), "sha", "author", "ts", "subject")


COMMITS_SQL = "commits as (select commit_row_id, project_name repo, sha, author, try_cast(case when regexp_full_match(trim(ts), '[+-]?[0-9]+') then trim(ts) end as bigint) ts, coalesce(subject, '') subject from commit_log)"


def facts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "file_facts", *columns)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, y, p): keyword label against a score in [0, 1] made of the file's size."""
    f = facts(spark, sf, "row_id", "bug_keyword", "loc", "n_authors")
    p = F.least(F.lit(1.0), F.round(F.coalesce(F.col("loc"), F.lit(0)) / 1000.0 + F.coalesce(F.col("n_authors"), F.lit(0)) / 50.0, 4))
    return f.where("bug_keyword is not null").select("row_id", F.col("bug_keyword").cast("int").alias("y"), F.greatest(p, F.lit(0.0)).alias("p"))


SCORES_SQL = "scores as (select row_id, cast(bug_keyword as int) y, greatest(least(1.0::double, round(coalesce(loc, 0) / 1000.0::double + coalesce(n_authors, 0) / 50.0::double, 4)), 0.0::double) p from file_facts where bug_keyword is not null)"
