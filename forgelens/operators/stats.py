"""Project statistics, health, tiers, distributions and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions import scalars

ALL = "<all>"



def project_stats(df: DataFrame) -> DataFrame:
    """Global and by-category statistics in one grouping-sets aggregate; the total row is ``<all>``."""
    d = df.select(
        F.coalesce("category_primary", F.lit("<null>")).alias("category"), "project_name", "loc", "smell_count", "bug_keyword", "bug_szz", "commits_to_first_bug", "refactor_ratio", "contribution_gini",
        F.expr("1000.0D * smell_count / nullif(loc, 0)").alias("density"),
    )
    z = lambda c, k=4: F.round(F.coalesce(c, F.lit(0.0)), k)
    rate = lambda c: z(F.avg((F.col(c) > 0).cast("double")))
    out = d.groupingSets([[], ["category"]], "category").agg(
        F.grouping("category").alias("g"), F.count_distinct("project_name").alias("n_projects"), F.count("*").alias("n_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
        z(F.avg(F.when(F.col("commits_to_first_bug") >= 0, F.col("commits_to_first_bug").cast("double"))), 2).alias("avg_commits_to_first_bug"), z(F.median("density")).alias("median_smell_density"),
        rate("bug_keyword").alias("bug_keyword_rate"), rate("bug_szz").alias("bug_szz_rate"), z(F.avg(F.col("refactor_ratio").cast("double"))).alias("avg_refactor_ratio"), z(F.avg(F.col("contribution_gini").cast("double"))).alias("avg_gini"),
    )
    return out.withColumn("category", F.when(F.col("g") == 1, ALL).otherwise(F.col("category"))).drop("g")


def project_health(df: DataFrame, key: str = "project_name") -> DataFrame:
    """Defects per thousand lines, commits and smells per project."""
    g = df.groupBy(key).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("bug_count").alias("bugs"), F.sum("commit_count").alias("commits"), F.sum(F.coalesce("smell_count", F.lit(0))).alias("smells"))
    kloc = F.col("loc") / 1000.0
    return g.select(
        key, "files", "loc", "bugs", "commits", "smells", F.round(F.when(kloc > 0, F.col("bugs") / kloc).otherwise(0.0), 2).alias("defect_density"),
        F.round(F.when(kloc > 0, F.col("smells") / kloc).otherwise(0.0), 2).alias("smell_density"), F.round(F.col("commits") / F.col("files"), 2).alias("avg_commits_per_file"),
        F.round(F.when(F.col("commits") > 0, F.col("bugs") / F.col("commits")).otherwise(0.0), 4).alias("bug_fix_ratio"),
    )


def smell_summary(files: DataFrame, key: str = "project_name", top: int = 5) -> DataFrame:
    """Per project from (project, file_path, loc, smell_count, bug_pred, smell_pred): totals, density, risk counts and the smelliest files.

    The top files are picked per project by partial aggregates that keep ``top`` entries, so no project is gathered whole.
    """
    entry = F.when(F.col("smell_count") > 0, F.struct((-F.col("smell_count")).alias("m"), F.col("file_path")))
    spread = files.withColumn("part_", F.pmod(F.xxhash64("file_path"), F.lit(64)))
    first = spread.groupBy(key, "part_").agg(
        F.sum(F.coalesce("smell_count", F.lit(0))).alias("smells"), F.sum("loc").alias("loc"), F.count_if(F.col("smell_pred") == 1).alias("risky"),
        F.count_if((F.col("smell_pred") == 1) & (F.col("bug_pred") == 1)).alias("priority"), F.slice(F.array_sort(F.collect_set(entry)), 1, top).alias("top"),
    )
    g = first.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("smells", "loc", "risky", "priority")], F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, top).alias("top"))
    kloc = F.col("loc") / 1000.0
    return g.select(
        key, F.col("smells").alias("total_smells"), F.round(F.when(kloc > 0, F.col("smells") / kloc).otherwise(0.0), 2).alias("smell_density"), F.col("risky").alias("smell_risk"),
        F.col("priority").alias("refactor_priority"), F.array_join(F.transform("top", lambda t: F.concat(t["file_path"], F.lit(":"), (-t["m"]).cast("string"))), " ").alias("top_files"),
    )


def tier_distribution(scored: DataFrame, score: str = "score") -> DataFrame:
    """(tier, files) over the fixed domain of tiers."""
    counts = scored.groupBy(scalars.risk_tier(F.col(score)).alias("tier")).agg(F.count("*").alias("files"))
    domain = scored.sparkSession.createDataFrame([("PASS",), ("REVIEW",), ("BLOCK",)], "tier string")
    return domain.join(counts, "tier", "left").fillna(0, ["files"])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) of a column's values."""
    g = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<null>")).alias("value")).agg(F.count("*").alias("n"))
    return g.select("value", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2).alias("pct"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, mean, median, max) of numeric columns in one pass."""
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.round(F.avg(F.col(c).cast("double")), 4).alias("mean"), F.median(F.col(c).cast("double")).alias("median"), F.max(F.col(c).cast("double")).alias("max")).alias(f"s{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")


def run_totals(status: DataFrame) -> DataFrame:
    """(status, n, pct, avg_seconds) and whether failures pass a tenth."""
    g = status.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 2).alias("avg_seconds"))
    every = Window.partitionBy()
    return g.select("status", "n", F.round(100.0 * F.col("n") / F.sum("n").over(every), 2).alias("pct"), "avg_seconds", (F.sum(F.when(F.col("status") != "ok", F.col("n")).otherwise(0)).over(every) > 0.1 * F.sum("n").over(every)).alias("many_failures"))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_per(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rn_ = 1").drop("rn_")


def evicted(tasks: DataFrame, as_of: str, ttl_seconds: int, most: int) -> DataFrame:
    """Tasks that stay: younger than the limit and among the newest ``most``."""
    young = tasks.where(F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("created_at") <= ttl_seconds)
    return young.orderBy(F.desc("created_at"), "task_id").limit(most)


def importance_summary(importances: DataFrame, share: float = 0.95) -> DataFrame:
    """(feature, mean, std, cumulative, kept): features until ``share`` of total importance, over a bounded feature list."""
    g = importances.groupBy("feature").agg(F.avg("importance").alias("m"), F.stddev_pop("importance").alias("s"))
    w = Window.orderBy(F.desc("m"), "feature")
    c = F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("m").over(Window.partitionBy())
    before = F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("m").over(Window.partitionBy())
    return g.select("feature", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), F.round(c, 6).alias("cumulative"), (before < share).alias("kept"))
