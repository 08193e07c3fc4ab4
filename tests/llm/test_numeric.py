from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forgelens.llm import cutoffs, quantiles, splits

from ..conftest import rows


def brute_cutoff(values, fraction):
    v = sorted(values, reverse=True)
    k = max(1, math.floor(fraction * len(v) + 0.5))
    c = v[k - 1]
    return len(v), k, c, sum(x >= c for x in v), sum(x > c for x in v)


def test_cutoffs_against_sorting(spark):
    rnd = random.Random(1)
    data = [("hot", float(rnd.randint(0, 40))) for _ in range(3000)] + [(f"p{i % 30}", rnd.gauss(0, 9)) for i in range(2000)] + [(None, 1.0), (None, 5.0), ("one", 7.0), ("same", 2.0), ("same", 2.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(data, "s string, x double").withColumn("weight", F.lit("clash")).withColumn("sid", F.lit(1)).repartition(6)
    by = {}
    for s, x in data:
        if x is not None and x == x:
            by.setdefault(s, []).append(x)
    for fraction in (0.2, 0.75, 1.0):
        got = {r["s"]: tuple(r)[1:] for r in cutoffs.cutoffs(df, "s", "x", fraction).collect()}
        assert got == {s: brute_cutoff(v, fraction) for s, v in by.items()}
    assert cutoffs.cutoffs(df.limit(0), "s", "x", 0.2).count() == 0
    with pytest.raises(ValueError, match="fraction"):
        cutoffs.cutoffs(df, "s", "x", 0)


def test_small_sketches_are_exact_and_extremes_stay_close(spark):
    rnd = np.random.default_rng(2)
    big = rnd.pareto(1.2, 60_000) * 10
    data = [("big", float(x)) for x in big] + [("small", float(i)) for i in range(50)] + [(None, 3.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double").withColumn("items", F.lit("clash")).repartition(8)
    ps = {"p50": 0.5, "p99": 0.99, "p999": 0.999}
    got = {r["g"]: r for r in quantiles.quantiles(quantiles.build(df, ["g"], "v"), ["g"], ps).collect()}
    assert set(got) == {"big", "small", None}
    assert (got["small"].n, got["small"].p50, got["small"].p99) == (50, 24.0, 49.0) and got[None].p50 == 3.0
    order = np.sort(big)
    assert got["big"].n == len(big)
    for name, p in ps.items():
        rank = np.searchsorted(order, got["big"][name], side="right")
        assert abs(rank - p * len(big)) <= 0.05 * (1 - p) * len(big) + 1, name


def test_days_merge_like_the_whole(spark):
    df = spark.range(20_000).select((F.col("id") % 10).alias("day"), F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("v"))
    days = quantiles.build(df, ["g", "day"], "v")
    merged = quantiles.quantiles(quantiles.merge(days, ["g"]), ["g"], {"p90": 0.9}).first()
    exact = df.agg(F.percentile("v", F.lit(0.9))).first()[0]
    assert merged.n == 20_000 and abs(merged.p90 - exact) / 100_000 < 0.01
    assert quantiles.build(df.limit(0), ["g"], "v").count() == 0


def test_sketch_protects_the_low_tail_too():
    s = quantiles.Sketch(protect="low")
    s.add(np.arange(100_000.0)[::-1])
    assert sum(w for w in s.weighted()[1]) == 100_000
    assert abs(s.quantiles([0.001])[0] - 100) <= 6


def test_canonical_names(spark):
    same = ["Owner/Repo", " owner/repo ", "https://git.example.org/owner/repo.git", "http://git.example.org/Owner/repo/", "git@git.example.org:owner/repo.git", "ssh://git@git.example.org/owner/repo", "git://git.example.org/owner/repo.git", "git.example.org/owner/repo", "owner/repo/"]
    other = ["owner/repo-fork", "owner/repo2", "owner/repo.github", "owners/repo"]
    df = spark.createDataFrame([(x,) for x in same + other], "n string").select(splits.canonical_name(F.col("n")).alias("c"))
    got = [r.c for r in df.collect()]
    assert set(got[:len(same)]) == {"owner/repo"} and len(set(got[len(same):])) == 4 and "owner/repo" not in got[len(same):]
    blank = spark.createDataFrame([("",), ("  ",), (None,)], "n string").select(splits.canonical_name(F.col("n")).alias("c"))
    assert [r.c for r in blank.collect()] == [None, None, None]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_components_of_paths_stars_cycles_and_noise(spark):
    rnd = random.Random(4)
    edges = [(f"a{i}", f"a{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(150)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    edges += [(f"r{rnd.randint(0, 80)}", f"r{rnd.randint(0, 80)}") for _ in range(50)] + [("a0", "a1"), ("x", "x"), (None, "y"), ("z", None)]
    got = {r.node: r.component for r in splits.components(spark.createDataFrame(edges, "p string, q string"), "p", "q").collect()}
    assert got == brute_components([(a, b) for a, b in edges if a and b and a != b])
    assert splits.components(spark.createDataFrame([], "p string, q string"), "p", "q").count() == 0


def test_pairs_and_shares(spark):
    names = spark.createDataFrame([("A/x",), ("a/x",), ("b/y",), ("c/z",), (None,)], "name string")
    aliases = spark.createDataFrame([("a/x", "b/y"), ("b/y", "a/x"), ("q/q", "q/q")], "o string, n string")
    found = splits.name_components(names, "name", aliases, "o", "n")
    assert rows(splits.same_entity_pairs(found), "name_a", "name_b") == [("A/x", "a/x"), ("A/x", "b/y"), ("a/x", "b/y")]
    sizes = spark.range(3000).select(F.col("id").cast("string").alias("component"), (F.col("id") % 7 + 1).alias("rows"))
    got = splits.split_components(sizes, (("train", 0.8), ("validation", 0.1), ("test", 0.1))).groupBy("split").agg(F.sum("rows").alias("n"))
    total = 3000 * 4
    assert {r.split: round(r.n / total, 2) for r in got.collect()} == {"train": 0.8, "validation": 0.1, "test": 0.1}


def test_sketches_stay_bounded_for_many_interleaved_keys(spark):
    df = spark.range(1_000_000).select((F.col("id") % 1000).alias("g"), F.xxhash64("id").cast("double").alias("v"), F.lit("clash").alias("items"))
    sizes = quantiles.build(df, ["g"], "v").select(F.size("items").alias("high"), F.size("low_items").alias("low")).agg(F.max("high").alias("high"), F.max("low").alias("low"), F.count("*").alias("n")).first()
    assert sizes.n == 1000 and max(sizes.high, sizes.low) < 1000  # values a key: 1000, all different


def test_both_tails_keep_relative_rank_error(spark):
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") * F.lit(7919) % n).cast("double").alias("v"), (F.col("id") % 40).alias("day"))
    ps = {"p0001": 0.0001, "p001": 0.001, "p05": 0.05, "p95": 0.95, "p999": 0.999, "p9999": 0.9999}
    got = quantiles.quantiles(quantiles.merge(quantiles.build(df, ["g", "day"], "v"), ["g"]), ["g"], ps).first()
    for k, p in ps.items():
        assert abs(got[k] + 1 - p * n) <= 0.05 * min(p * n, n - p * n) + 1, (k, got[k])
