"""Assembling, filtering, capping and upserting the wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing somewhere is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order; ties should be broken by the caller."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def coerced(df: DataFrame, kinds: dict[str, str], nullable: Sequence[str] = ()) -> DataFrame:
    """Columns cast by ``kinds``; what cannot be read becomes 0, empty or false, or stays null where ``nullable``."""
    default = {"int": 0, "float": 0.0, "double": 0.0, "tinyint": 0, "bigint": 0, "string": "", "boolean": False}
    cols = []
    for name, kind in kinds.items():
        raw = F.col(name) if name in df.columns else F.lit(None)
        c = raw.try_cast(kind) if kind not in ("string",) else raw.cast("string")
        cols.append((c if name in nullable else F.coalesce(c, F.lit(default[kind]).cast(kind))).alias(name))
    return df.select(*[c for c in df.columns if c not in kinds], *cols)


def feature_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named features in order as doubles; a missing column or value is 0."""
    return df.select(*[(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)).alias(n) for n in names])


def extract_xy(df: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Features and label; a missing column raises, a missing value is 0."""
    missing = [n for n in [*names, label] if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names], F.coalesce(F.col(label).cast("long"), F.lit(0)).alias("label"))


def commit_range(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Inclusive range of commit_count, either bound optional."""
    if least is not None:
        df = df.where(F.col("commit_count") >= least)
    return df if most is None else df.where(F.col("commit_count") <= most)


def sampled_projects(df: DataFrame, n: int, seed: int = 42, key: str = "project_name") -> DataFrame:
    """All rows of the first ``n`` projects in seeded hash order (the sampling operator's own limit); rows without project are left out."""
    names = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(names.orderBy(F.md5(F.concat(key, F.lit(f"|{seed}"))), key).limit(n), key, "left_semi")


def enough_files(df: DataFrame, least: int, key: str = "project_name") -> DataFrame:
    """Rows of projects with at least ``least`` files; sizes are counted map-side, then joined."""
    big = df.groupBy(F.col(key).alias("k_")).agg(F.count("*").alias("n_")).where(F.col("n_") >= least)
    return df.join(big, F.col(key).eqNullSafe(F.col("k_")), "left_semi")


def capped(df: DataFrame, most: int, unique: str, seed: str = "42", key: str = "project_name") -> DataFrame:
    """A seeded sample of at most ``most`` rows per project, without replacement, in hash order.

    Rows are ranked within hash buckets first, so only ``most`` rows of each bucket meet in the final
    ranking of a project, however many it has.
    """
    h = F.md5(F.concat(F.col(unique).cast("string"), F.lit("|" + seed)))
    pre = df.withColumn("h_", h).withColumn("b_", F.substring("h_", 1, 2))
    pre = pre.withColumn("r_", F.row_number().over(Window.partitionBy(key, "b_").orderBy("h_", unique))).where(F.col("r_") <= most)
    return pre.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy("h_", unique))).where(F.col("r_") <= most).drop("h_", "b_", "r_")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win over old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def backfilled(rows: DataFrame, meta: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Empty text cells take the project's metadata; ``meta`` has one row per key."""
    m = meta.select(F.col(key).alias("k_"), *[F.col(c).alias(f"m_{c}") for c in columns])
    out = rows.join(m, F.col(key) == F.col("k_"), "left")
    for c in columns:
        own = F.col(c) if c in rows.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.when(own != "", own), F.col(f"m_{c}"), F.lit("")))
    return out.drop("k_", *[f"m_{c}" for c in columns])


def sensitivity(df: DataFrame, scenarios: Sequence[tuple[int | None, int | None]]) -> DataFrame:
    """files, projects and label rates per (min, max) scenario of commit_count; empty ones keep a row.

    Scenarios are a literal list of a few ranges; rows are expanded in place and aggregated map-side.
    """
    schema = T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])
    grid = df.sparkSession.createDataFrame(list(scenarios), schema)
    ranges = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).cast("int").alias("lo"), F.lit(hi).cast("int").alias("hi")) for i, (lo, hi) in enumerate(scenarios)])
    hit = F.filter(ranges, lambda r: (r["lo"].isNull() | (F.col("commit_count") >= r["lo"])) & (r["hi"].isNull() | (F.col("commit_count") <= r["hi"])))
    agg = df.select("project_name", "label_commit", "smell_binary", F.explode(hit).alias("r")).groupBy("r.lo", "r.hi").agg(
        F.count("*").alias("files"), F.count_distinct("project_name").alias("projects"),
        F.round(100 * F.avg(F.col("label_commit").cast("double")), 2).alias("pct_label_pos"), F.round(100 * F.avg(F.col("smell_binary").cast("double")), 2).alias("pct_smell_pos"),
    )
    a = agg.withColumnsRenamed({"lo": "l_", "hi": "h_"})
    return grid.join(a, F.col("lo").eqNullSafe(F.col("l_")) & F.col("hi").eqNullSafe(F.col("h_")), "left").select("lo", "hi", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("projects", F.lit(0)).alias("projects"), "pct_label_pos", "pct_smell_pos")
