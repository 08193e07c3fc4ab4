"""Commit history aggregates per file and per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions import text

DAY = 86400
RECENT_DAYS = 90


def parsed_commits(log: DataFrame) -> DataFrame:
    """The commit log with numeric seconds; a malformed time is null and the commit still counts."""
    return log.withColumn("ts", F.expr("try_cast(trim(ts) as bigint)")).withColumn("subject", F.coalesce("subject", F.lit("")))


def split_log_lines(lines: DataFrame, line: str = "line", *keep: str) -> DataFrame:
    """(kept columns, ts, author, subject) of ``ts|author|subject`` lines; the subject keeps further bars."""
    p = F.split(F.col(line), r"\|", 3)
    return lines.where(F.size(p) == 3).select(*keep, p[0].alias("ts"), p[1].alias("author"), p[2].alias("subject"))


def file_stats(touches: DataFrame, as_of: int) -> DataFrame:
    """Process metrics per (project, path) from touches (project, path, sha, author, ts, subject, added, deleted).

    A binary touch has null added or deleted: it counts as a commit but not as churn. One aggregate over
    one shuffle on (project, path); keyword groups are sums of flags.
    """
    bug = text.is_bug_message(F.col("subject"))
    churn = F.col("added") + F.col("deleted")
    groups = [F.sum(c).cast("long").alias(f"bug_kw_{g}_count") for g, c in text.bug_groups(F.col("subject")).items()]
    return touches.groupBy("project", "path").agg(
        F.count("*").alias("commit_count"), F.sum(bug.cast("long")).alias("bug_count"), *groups, F.count_distinct("author").alias("n_authors"),
        F.round(F.greatest((F.lit(as_of) - F.min("ts")) / DAY, F.lit(0.5)), 1).alias("file_age_days"),
        F.coalesce(F.sum(churn), F.lit(0)).cast("double").alias("churn_total"), F.round(F.coalesce(F.avg(churn), F.lit(0.0)), 1).alias("avg_churn_per_commit"),
        F.coalesce(F.max(churn), F.lit(0)).cast("double").alias("max_single_churn"), F.sum((F.col("ts") >= as_of - RECENT_DAYS * DAY).cast("long")).alias("recent_commits_90d"),
    )


def author_counts(commits: DataFrame) -> DataFrame:
    return commits.where("author is not null").groupBy("repo", "author").agg(F.count("*").alias("n"))


def gini(counts: DataFrame) -> DataFrame:
    """Gini coefficient of commits per author: 2*sum(i*v)/(n*sum(v)) - (n+1)/n over ascending v.

    Authors with equal counts are folded into one row before ranking, so a repository's window holds as
    many rows as it has different counts.
    """
    folded = counts.groupBy("repo", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("repo").orderBy("n")
    before = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = folded.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    s = ranked.groupBy("repo").agg(F.sum(F.col("n") * F.col("ranks")).alias("iv"), F.sum("c").alias("m"), F.sum(F.col("n") * F.col("c")).alias("total"))
    return s.select("repo", F.round(F.coalesce(2.0 * F.col("iv") / F.nullif(F.col("m") * F.col("total"), F.lit(0)) - (F.col("m") + 1) / F.col("m"), F.lit(0.0)), 4).alias("contribution_gini"))


def entropy(counts: DataFrame) -> DataFrame:
    """Shannon entropy in bits of author shares: log2(N) - sum(n*log2 n)/N."""
    s = counts.groupBy("repo").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    return s.select("repo", F.round(F.log2("t") - F.col("nl") / F.col("t"), 4).alias("author_entropy"))


def gaps(commits: DataFrame) -> DataFrame:
    """(repo, gap) of commits in a row, one row a commit but the first of a repository, whose gap is null.

    Rows are sorted within blocks of 30 days, and a block's first gap reaches back to the end of the block
    before it, so a repository with a third of all commits is spread over its blocks.
    """
    placed = commits.where("ts is not null").select("repo", "ts", F.floor(F.col("ts") / (30 * DAY)).alias("block"))
    inner = Window.partitionBy("repo", "block").orderBy("ts")
    within = placed.select("repo", (F.col("ts") - F.lag("ts").over(inner)).alias("gap"), F.row_number().over(inner).alias("rn")).where("rn > 1").drop("rn")
    ends = placed.groupBy("repo", "block").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    between = ends.select("repo", (F.col("first") - F.lag("last").over(Window.partitionBy("repo").orderBy("block"))).alias("gap"))
    return within.unionByName(between)


def cadence(commits: DataFrame) -> DataFrame:
    """Population standard deviation over mean of the gaps between commits; 0 for one gap or fewer, or mean 0."""
    g = gaps(commits).groupBy("repo").agg(F.count("gap").alias("k"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    return g.select("repo", F.round(F.when((F.col("k") >= 1) & (F.col("m") > 0), F.col("s") / F.col("m")).otherwise(0.0), 4).alias("inter_commit_time_cv"))


def repo_summary(commits: DataFrame, as_of: int) -> DataFrame:
    """Counts, ratio, Gini, cadence and entropy per repository, joined on one key."""
    flag = lambda c: F.sum(c.cast("long"))
    base = commits.groupBy("repo").agg(
        F.count("*").alias("total_commits"), flag(text.is_bug_message(F.col("subject"))).alias("bug_commits"), flag(text.is_refactor_message(F.col("subject"))).alias("refactor_commits"),
        flag(text.is_revert(F.col("subject"))).alias("revert_count"), flag(F.coalesce(F.col("ts") >= as_of - RECENT_DAYS * DAY, F.lit(False))).alias("recent_commits"),
    ).withColumn("refactor_ratio", F.round(F.col("refactor_commits") / F.col("total_commits"), 4))
    counts = author_counts(commits)
    out = base
    for side in (gini(counts), cadence(commits), entropy(counts)):
        out = out.join(side.withColumnRenamed("repo", "r_"), F.col("repo").eqNullSafe(F.col("r_")), "left").drop("r_")
    return out.fillna(0.0, ["contribution_gini", "inter_commit_time_cv", "author_entropy"])


def bug_series_stats(series: DataFrame) -> DataFrame:
    """One row: mean and median commits to the first bug, mean gap between bugs, over (file, idx, is_intro)."""
    bugs = series.where("is_intro = 1")
    first = bugs.groupBy("file").agg(F.min("idx").alias("first"))
    gaps = bugs.select((F.col("idx") - F.lag("idx").over(Window.partitionBy("file").orderBy("idx"))).alias("gap"))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    a = first.agg(F.count("*").alias("files_with_bug"), z(F.avg("first")).alias("mean_to_first"), z(F.median("first").cast("double")).alias("median_to_first"))
    return a.crossJoin(gaps.agg(z(F.avg("gap")).alias("mean_between")))  # one row each


def trailing_count(commits: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """Each commit with the number of commits of its repository in the days before it, itself included.

    The window runs over blocks as long as the days; every commit also stands in the next block, where it
    is only counted, so no repository is sorted in one task.
    """
    block = F.floor(F.col("ts") / (days * DAY))
    placed = commits.where("ts is not null").withColumn("block_", F.explode(F.array(block, block + 1))).withColumn("own_", F.col("block_") == block)
    w = Window.partitionBy("repo", "block_").orderBy("ts").rangeBetween(-days * DAY, 0)
    return placed.withColumn("trailing", F.count("*").over(w)).where("own_").drop("block_", "own_")


def parsed_numstat(lines: DataFrame, line: str, *keep: str) -> DataFrame:
    """(kept columns, added, deleted, path) of ``added<TAB>deleted<TAB>path`` lines.

    A dash, as of a binary file, gives null counts; a line of other than three fields is left out.
    """
    p = F.split(F.col(line), "\t")
    number = lambda c: F.when(F.trim(c) != "-", c.try_cast("double"))
    return lines.where(F.size(p) == 3).select(*keep, number(p[0]).alias("added"), number(p[1]).alias("deleted"), F.translate(p[2], "\\", "/").alias("path"))


def line_labels(lines: DataFrame, head: DataFrame) -> DataFrame:
    """(path, bug_szz) of every file at HEAD from line touches (path, line, sha, ts, is_fix).

    A file is 1 if a bug fix touched one of its lines that an earlier commit had written, else 0. One
    aggregate per line finds the first writing and the last fix, so lines are joined with nothing.
    """
    per_line = lines.groupBy("path", "line").agg(F.min("ts").alias("first"), F.max(F.when(F.col("is_fix"), F.col("ts"))).alias("fixed"))
    bad = per_line.where("fixed > first").select("path").distinct().withColumn("bad_", F.lit(1))
    return head.select("path").distinct().join(bad, "path", "left").select("path", F.coalesce("bad_", F.lit(0)).alias("bug_szz"))


def touched_by(lines: DataFrame, fixes: DataFrame, head: DataFrame) -> DataFrame:
    """Files at HEAD with a line that a bug-fix commit changed: (path, bug_szz = 1)."""
    return lines.join(fixes, "sha", "left_semi").join(head, "path", "left_semi").select("path").distinct().withColumn("bug_szz", F.lit(1))


def bug_fix_hashes(commits: DataFrame) -> DataFrame:
    return commits.where(text.is_bug_message(F.col("subject"))).select("sha").distinct()


def recent(ts: Column, as_of: int) -> Column:
    return ts >= as_of - RECENT_DAYS * DAY
