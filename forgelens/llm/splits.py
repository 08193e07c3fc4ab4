"""Splits that keep related records together, by frontier breadth-first components.

Names are nodes (canonical form, see ``canonical_name``); recorded renames are edges. The adjacency
list is hash-partitioned; every node that precedes all its neighbours in hash order seeds a search,
all searches expand their frontiers at once, and where two searches meet their seed labels become an
edge of a smaller graph, which is labelled in the same way until no searches meet.

Defined cases: null or blank names join nothing and, as records without a known entity, form one
component of their own (``<null>``); self-renames and repeated or circular renames are harmless;
empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.session import cut

NULL_ENTITY = "<null>"
MAX_ROUNDS = 400


def canonical_name(name: Column, host: str = "git.example.org") -> Column:
    """Lower-case owner/repository without blanks, scheme, user, host, trailing slash or ``.git``."""
    h = host.replace(".", "\\.")
    t = F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    bare = F.regexp_replace(t, rf"^(?:(?:[a-z][a-z0-9+]*://)(?:[^@/]*@)?(?:www\.)?{h}(?::\d+)?/+|(?:[^@/\s]+@)?{h}(?::|/)/*)", "")
    addressed = bare != t
    tail = F.regexp_replace(bare, r"/+$", "")
    tail = F.when(addressed, F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"[?#].*$", ""), r"/+$", ""), r"\.git$", "")).otherwise(F.regexp_replace(tail, r"\.git$", ""))
    return F.when(tail != "", tail)


def _label(edges: DataFrame) -> DataFrame:
    """(node, label): one label per connected component of the undirected ``edges`` (a, b), a != b."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().repartition("a"))
    lowest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
    is_seed = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n")) < F.col("m")
    nodes = cut(lowest.select(F.col("a").alias("node"), F.when(is_seed, F.col("a")).alias("label")))
    found = nodes.where("label is not null")
    frontier = found
    for _ in range(MAX_ROUNDS):
        reached = (
            frontier.join(both, F.col("node") == F.col("a")).groupBy("b").agg(F.min("label").alias("label"))
            .select(F.col("b").alias("node"), "label").join(found.select("node"), "node", "left_anti")
        )
        frontier = cut(reached)
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    else:
        raise RuntimeError("search did not end")
    meet = (
        both.join(found.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        .join(found.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        .where("la < lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    )
    meet = cut(meet)
    if meet.isEmpty():
        return found
    above = _label(meet).select(F.col("node").alias("label"), F.col("label").alias("upper"))
    return found.join(above, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in ``links``; the component is its smallest node in binary order.

    Every component's seeds, frontiers and collisions stay distributed; a node of very high degree is a
    row of ``frontier`` joined with its adjacency list, which the join may split when it is skewed.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    labels = cut(_label(edges))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


def name_components(names: DataFrame, name: str, aliases: DataFrame, old: str, new: str) -> DataFrame:
    """(name, component) of every distinct name; null names have no row."""
    spelled = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("node", canonical_name(F.col("name")))
    links = aliases.select(canonical_name(F.col(old)).alias("a"), canonical_name(F.col(new)).alias("b"))
    linked = components(links, "a", "b")
    return spelled.join(linked, "node", "left").select("name", F.coalesce("component", "node", F.lit(NULL_ENTITY)).alias("component"))


def same_entity_pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b) with name_a < name_b: the pairs of spellings the caller asked for."""
    known = found.where(F.col("component") != NULL_ENTITY)
    a = known.select("component", F.col("name").alias("name_a"))
    b = known.select("component", F.col("name").alias("name_b"))
    return a.join(b, "component").where("name_a < name_b").select("name_a", "name_b")


def split_components(sizes: DataFrame, shares: Sequence[tuple[str, float]], buckets: int = 4096) -> DataFrame:
    """(component, rows, split): components in hash order, cut where the running rows pass each share.

    ``sizes`` is (component, rows). The hash order is taken in two steps: rows per hash bucket (at most
    ``buckets`` rows, running sum in one task) and the running sum within a bucket, so no task sorts
    all components. A component belongs to the split its middle row falls into.
    """
    total_share = sum(s for _, s in shares)
    if abs(total_share - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    keyed = sizes.select("component", "rows", F.md5("component").alias("h")).withColumn("bucket", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(2 ** 32 // buckets), F.lit(buckets)).cast("int"))
    per = keyed.groupBy("bucket").agg(F.sum("rows").alias("in_bucket"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("bucket", F.coalesce(F.sum("in_bucket").over(order), F.lit(0)).alias("before"), F.sum("in_bucket").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(F.broadcast(per), "bucket").withColumn("start", F.col("before") + F.coalesce(F.sum("rows").over(within), F.lit(0)))
    middle = (F.col("start") + F.col("rows") / 2) / F.col("total")
    split, edge = None, 0.0
    for label, share in shares[:-1]:
        edge += share
        split = F.when(middle < edge, label) if split is None else split.when(middle < edge, label)
    split = F.lit(shares[-1][0]) if split is None else split.otherwise(shares[-1][0])
    return placed.select("component", "rows", split.alias("split"))
