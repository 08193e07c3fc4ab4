"""Labels: smell percentile, commit median, keyword, line history, CI/CD signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files whose presence at the root of a repository is a signal.
FILE_SIGNALS = {
    "has_travis": ".travis.yml",
    "has_jenkins": "Jenkinsfile",
    "has_gitlab_ci": ".gitlab-ci.yml",
    "has_dockerfile": "Dockerfile",
    "has_pre_commit": ".pre-commit-config.yaml",
}
COMPOSE = r"^(docker-compose.*|compose)\.ya?ml$"
WORKFLOWS = ".github/workflows"


def smell_thresholds(facts: DataFrame, share: float = 0.8) -> DataFrame:
    """(project_name, threshold): interpolated quantile of the non-null smell counts of each project.

    Equal counts are folded before the quantile (``percentile`` with frequencies), so a project with a
    third of all rows is a histogram of its different counts.
    """
    folded = facts.where("smell_count is not null").groupBy("project_name", "smell_count").agg(F.count("*").alias("n"))
    return folded.groupBy("project_name").agg(F.percentile("smell_count", F.lit(share), F.col("n")).alias("threshold"))


def with_smell_binary(facts: DataFrame, share: float = 0.8) -> DataFrame:
    """``smell_binary`` = 1 where smell_count reaches its project's quantile; null counts give 0."""
    t = smell_thresholds(facts, share).withColumnRenamed("project_name", "p_")
    return facts.drop("smell_binary").join(t, F.col("project_name").eqNullSafe(F.col("p_")), "left").withColumn("smell_binary", F.coalesce(F.col("smell_count") >= F.col("threshold"), F.lit(False)).cast("tinyint")).drop("p_", "threshold")


def commit_median(facts: DataFrame) -> DataFrame:
    """One row: the exact median of commit_count, from the histogram of its values."""
    folded = facts.where("commit_count is not null").groupBy("commit_count").agg(F.count("*").alias("n"))
    return folded.agg(F.percentile("commit_count", F.lit(0.5), F.col("n")).alias("median"))


def with_commit_label(facts: DataFrame) -> DataFrame:
    """``label_commit`` = 1 strictly above the global median, 0 otherwise and for null counts."""
    return facts.drop("label_commit").crossJoin(F.broadcast(commit_median(facts))).withColumn("label_commit", F.coalesce(F.col("commit_count") > F.col("median"), F.lit(False)).cast("tinyint")).drop("median")  # one row


def bug_keyword(bug_count: Column) -> Column:
    return (F.coalesce(bug_count, F.lit(0)) > 0).cast("tinyint")


def ci_signals(listing: DataFrame) -> DataFrame:
    """Eight boolean signals per repository from (repo, path, is_dir) of its listing."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    file = ~F.col("is_dir")
    aggs = [has(F.col("is_dir") & (F.col("path") == WORKFLOWS)).alias("has_github_actions"), has(file & F.col("path").rlike(COMPOSE)).alias("has_compose")]
    aggs += [has(file & (F.col("path") == p)).alias(n) for n, p in FILE_SIGNALS.items()]
    out = listing.groupBy("repo").agg(*aggs)
    flags = ["has_github_actions", "has_travis", "has_jenkins", "has_gitlab_ci", "has_dockerfile", "has_compose", "has_pre_commit"]
    return out.select("repo", *flags, F.greatest(*flags).alias("is_devops_project"))
