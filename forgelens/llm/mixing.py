"""Mixing sources to target shares of all tokens, with capped repeats.

Every source contributes ``share * total`` tokens: whole passes over its documents, at most its
``max_repeats``, and for the rest the documents whose hash lies below a threshold. The threshold is
found without sorting: tokens are summed by source and hash bucket, the bucket in which the budget runs
out is refined by the next bits of the hash, and only that one, until it is a single hash value.

The total is, unless given, the largest at which every present source can meet its share, shares being
scaled to the present sources. With a given total, a source too small gives all it may and the report
shows the shortfall; a source without tokens gives nothing.

Defined cases: documents with null source, or a source without target, take no part; documents without
tokens are left out; targets with null or non-positive share or repeats ask for nothing; repeated rows
have equal hashes and go together; empty tables give no documents and shares of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.session import cut

BITS, LEVELS = 12, 4  # 48 bits of the hash, 4096 buckets at a time
MAX_TARGETS = 10_000


def plan(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, want, passes, rest) of every target."""
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    sizes = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    t = wanted.join(sizes, "source", "left").fillna(0, ["documents", "available"])
    every = Window.partitionBy()  # targets only: a handful of rows
    if total is None:
        present = F.col("available") > 0
        scale = F.sum(F.when(present, F.col("target_share")).otherwise(0.0)).over(every)
        t = t.withColumn("share", F.when(present, F.col("target_share") / scale).otherwise(0.0))
        t = t.withColumn("total", F.coalesce(F.min(F.when(present, F.col("available") * F.col("max_repeats") / F.col("share"))).over(every), F.lit(0.0)))
    else:
        t = t.withColumn("share", F.col("target_share")).withColumn("total", F.lit(float(total)))
    want = F.least(F.floor(F.col("share") * F.col("total") + 1e-6), F.col("available") * F.col("max_repeats"))
    passes = F.when(F.col("available") > 0, F.floor(F.col("want") / F.col("available"))).otherwise(0)
    return t.withColumn("want", want).withColumn("passes", passes).withColumn("rest", F.col("want") - F.col("passes") * F.col("available")).select("source", "target_share", "max_repeats", "documents", "available", "want", "passes", "rest")


def _lookup(values: dict[str, int], key: Column) -> Column:
    """A literal map of sources; null where a source has no value."""
    if not values:
        return F.lit(None).cast("long")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])[key]


def thresholds(hashed: DataFrame, rest: dict[str, int]) -> dict[str, int]:
    """The hash below which a source's documents sum to its rest, to the nearest document.

    Each level sums tokens by source and bucket (at most 4096 rows a source) within the prefix that the
    level before left open, and sends one row a source to the driver; documents outside the boundary
    buckets are not summed again.
    """
    left, prefix = dict(rest), dict.fromkeys(rest, 0)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = hashed.withColumn("left", _lookup(left, F.col("source"))).where("left is not null")
        if level:
            inside = inside.where(F.shiftright("h", shift + BITS) == _lookup(prefix, F.col("source")))
        sums = inside.groupBy("source", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        run = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        rows = run.groupBy("source").agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("taken"),
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "tokens"))).alias("open"), F.max("bucket").alias("end"),
        ).collect()
        for r in rows:
            if r["open"] is None:  # all fits: the threshold is past the last document
                prefix[r["source"]] = r["end"] + 1
            else:
                prefix[r["source"]] = r["open"]["bucket"]
            left[r["source"]] -= r["taken"]
            if level == LEVELS - 1 and r["open"] is not None and r["open"]["tokens"] - left[r["source"]] < left[r["source"]]:
                prefix[r["source"]] += 1  # the document at the boundary brings the sum nearer
        seen = {r["source"] for r in rows}
        for source in prefix.keys() - seen:  # past the last document of the level before
            prefix[source] <<= BITS if level else 0
    return prefix


def mix(sized: DataFrame, targets: DataFrame, seed: str = "mix", total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, tokens, copies), plans) from ``sized`` (doc_id, source, tokens).

    The plan has one row a source with a target, a table people write by hand; more than ``MAX_TARGETS``
    raise. It is the only thing the driver holds.
    """
    used = sized.where("tokens > 0 and source is not null")
    plans = cut(plan(used, targets, total))
    rows = plans.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError("too many sources with a target")
    hashed = used.withColumn("h", F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << (BITS * LEVELS)) - 1)))
    below = thresholds(hashed, {r["source"]: int(r["rest"]) for r in rows if r["rest"] > 0})
    passes = _lookup({r["source"]: int(r["passes"]) for r in rows}, F.col("source"))
    extra = F.coalesce((F.col("h") < _lookup(below, F.col("source"))).cast("long"), F.lit(0))
    return hashed.withColumn("copies", (passes + extra).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies"), plans


def shares(mixed: DataFrame, plans: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, documents, available, wanted, tokens, max_copies) of every target."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("max_copies"))
    t = plans.join(got, "source", "left").fillna(0, ["tokens", "max_copies"])
    total = F.sum("tokens").over(Window.partitionBy())
    return t.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "documents", "available", F.col("want").cast("long").alias("wanted"), "tokens", "max_copies")
