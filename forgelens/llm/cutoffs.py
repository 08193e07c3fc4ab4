"""Score cutoffs that keep a target fraction of each source, by distributed quickselect.

For every source the cutoff is the k-th largest score, k = max(1, floor(fraction * n + 0.5)),
n the number of its rows whose score is neither null nor NaN. Rows scoring at or above the cutoff are kept,
so ties at the cutoff are kept together and ``kept_size`` may exceed ``target_size``; ``kept_above``
counts the rows strictly above, for callers that prefer the smaller side.

Defined cases: sources without any score, and an empty table, give no row; the null source is a
source of its own; repeated rows count each time; other columns are never read, so clashing names
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from forgelens.session import cut

BROADCAST_SOURCES = 100_000  # pivots are broadcast up to this many open sources, joined by shuffle beyond
MAX_ROUNDS = 200  # a guard against endless loops only; every round removes at least the pivot


def _partition_medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weighted median of each source's candidates within one partition, with their weight.

    One numpy sort per batch; an Arrow batch is the unit, so memory stays bounded whatever the
    partition holds, and a source gets one median a batch.
    """
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf.sort_values(["sid", "score"], kind="stable")
        sid, weight = pdf["sid"].to_numpy(), pdf["weight"].to_numpy()
        starts = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
        running = np.cumsum(weight)
        before = np.r_[0, running][starts]
        total = np.add.reduceat(weight, starts)
        at = np.searchsorted(running, before + (total + 1) // 2)
        yield pd.DataFrame({"sid": sid[starts], "median": pdf["score"].to_numpy()[at], "mass": total})


def cutoffs(df: DataFrame, source: str, score: str, fraction: float) -> DataFrame:
    """(source, n_scored, target_size, cutoff, kept_size, kept_above) of every source.

    Equal scores are folded into weighted rows before the first shuffle, so a source holding a third
    of all rows costs no more than its distinct scores. Each round then takes the weighted median of
    its partition medians as the source's pivot, counts what lies above and at it, and keeps only the
    side where the wanted rank is.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("median", T.DoubleType()), T.StructField("mass", T.LongType())])
    scored = df.select(F.col(source).alias("source"), F.col(score).cast("double").alias("score")).where("score is not null and not isnan(score)")
    folded = cut(scored.groupBy("source", "score").agg(F.count("*").alias("weight")))
    sources = (
        folded.groupBy("source").agg(F.sum("weight").alias("n"))
        .withColumn("sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
        .withColumn("target", F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.col("n") + 0.5)).cast("long"))
    )
    sources = cut(sources)
    if sources.select(F.count("*") != F.count_distinct("sid")).first()[0]:
        raise ValueError("two sources share a 64-bit id")
    live = folded.withColumn("sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))).join(
        sources.select("sid", F.col("target").alias("rank")), "sid"
    ).select("sid", "score", "weight", "rank", F.lit(0).cast("long").alias("above"))
    live = cut(live)
    done: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        medians = live.select("sid", "score", "weight").mapInPandas(_partition_medians, schema)
        order = Window.partitionBy("sid").orderBy("median")
        # partition medians: at most a few a partition and source
        pivots = (
            medians.withColumn("seen", F.sum("mass").over(order)).withColumn("all", F.sum("mass").over(Window.partitionBy("sid")))
            .where(F.col("seen") * 2 >= F.col("all")).groupBy("sid").agg(F.min("median").alias("pivot"))
        )
        pivots = cut(pivots)
        open_sources = pivots.count()
        if open_sources == 0:
            break
        side = (lambda d: F.broadcast(d)) if open_sources <= BROADCAST_SOURCES else (lambda d: d)
        with_pivot = live.join(side(pivots), "sid")
        counts = with_pivot.groupBy("sid").agg(
            F.first("pivot").alias("pivot"), F.first("rank").alias("rank0"), F.first("above").alias("above0"),
            F.sum(F.when(F.col("score") > F.col("pivot"), F.col("weight")).otherwise(0)).alias("gt"),
            F.sum(F.when(F.col("score") == F.col("pivot"), F.col("weight")).otherwise(0)).alias("eq"),
        )
        counts = cut(counts)
        done.append(counts.where("rank0 > gt and rank0 <= gt + eq").select("sid", F.col("pivot").alias("cutoff"), (F.col("above0") + F.col("gt")).alias("kept_above"), (F.col("above0") + F.col("gt") + F.col("eq")).alias("kept_size")))
        left = counts.where("rank0 <= gt or rank0 > gt + eq").select("sid", "pivot", "gt", "eq", (F.col("rank0") <= F.col("gt")).alias("upper"))
        live = cut(
            live.join(side(left), "sid")
            .where((F.col("upper") & (F.col("score") > F.col("pivot"))) | (~F.col("upper") & (F.col("score") < F.col("pivot"))))
            .select(
                "sid", "score", "weight",
                F.when(F.col("upper"), F.col("rank")).otherwise(F.col("rank") - F.col("gt") - F.col("eq")).alias("rank"),
                F.when(F.col("upper"), F.col("above")).otherwise(F.col("above") + F.col("gt") + F.col("eq")).alias("above"),
            )
        )
    else:
        raise RuntimeError("quickselect did not end")
    found = done[0] if done else sources.select("sid", F.lit(0.0).alias("cutoff"), F.lit(0).cast("long").alias("kept_above"), F.lit(0).cast("long").alias("kept_size")).limit(0)
    for d in done[1:]:
        found = found.unionByName(d)
    return sources.join(found, "sid").select(
        F.col("source").alias(source), F.col("n").alias("n_scored"), F.col("target").alias("target_size"), "cutoff", "kept_size", "kept_above"
    )
