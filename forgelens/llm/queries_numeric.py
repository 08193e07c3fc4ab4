"""Queries of the cutoff, percentile and split operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.llm import cutoffs, quantiles, splits
from forgelens.session import table

KEEP = 0.2
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def p2_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    """Cutoff on smell_count per project keeping a fifth of its scored rows."""
    return cutoffs.cutoffs(table(spark, sf, "file_facts", "project_name", "smell_count"), "project_name", "smell_count", KEEP)


P2_SQL = f"""
with s as (select project_name, cast(smell_count as double) score from file_facts where smell_count is not null),
n as (select project_name, count(*) n_scored, greatest(1, cast(floor({KEEP} * count(*) + 0.5) as bigint)) target_size from s group by project_name),
r as (select project_name, score, row_number() over (partition by project_name order by score desc) k from s),
c as (select n.project_name, n.n_scored, n.target_size, r.score cutoff from n join r on n.project_name is not distinct from r.project_name and r.k = n.target_size)
select c.project_name, c.n_scored, c.target_size, c.cutoff,
  count(*) filter (where s.score >= c.cutoff) kept_size, count(*) filter (where s.score > c.cutoff) kept_above
from c join s on c.project_name is not distinct from s.project_name group by all
"""


def _day_sketches(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "file_facts", "project_name", "commit_count", "collected_at").withColumn("day", F.to_date("collected_at"))
    return quantiles.build(facts, ["project_name", "day"], "commit_count")


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of commit_count per project, from sketches of its days of collected_at, merged."""
    merged = quantiles.merge(_day_sketches(spark, sf), ["project_name"])
    return quantiles.quantiles(merged, ["project_name"], PERCENTILES)


BOUND = 0.05  # of the rank distance to the nearer end


def p4_error(spark: SparkSession, sf: str) -> DataFrame:
    """The exact percentiles of each project, null where the sketch's estimate has a rank error beyond ``BOUND``.

    For an estimate x of percentile p the true ranks of x span [below + 1, at or below]; the error is the
    distance of p*n to that span, relative to the distance of p*n to the protected end.
    """
    counted = table(spark, sf, "file_facts", "project_name", "commit_count").where("commit_count is not null").groupBy("project_name", F.col("commit_count").cast("double").alias("v")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("project_name").orderBy("v")  # over different values, already folded
    ranked = counted.select(F.col("project_name").alias("name"), "v", "c", F.sum("c").over(by).alias("upto"))
    est = p4_percentiles(spark, sf)
    hit = est.join(ranked, est["project_name"].eqNullSafe(ranked["name"]))
    out = {}
    for k, p in PERCENTILES.items():
        target = F.greatest(F.lit(1.0), F.ceil(F.lit(p) * F.col("n") - 1e-9))
        end = F.greatest(F.col("n") - target + 1 if p >= 0.5 else target, F.lit(1.0))
        off = F.greatest(F.col("upto") - F.col("c") + 1 - target, target - F.col("upto"), F.lit(0.0)) / end
        exact = F.min(F.when(F.col("upto") >= target, F.col("v")))
        out[k] = F.when(F.max(F.when(F.col("v") == F.col(k), off)) <= BOUND, exact).alias(k)
    return hit.groupBy("project_name", "n").agg(*[out[k].alias(f"x_{k}") for k in PERCENTILES]).select("project_name", "n", *[F.col(f"x_{k}").alias(k) for k in PERCENTILES])


P4_ERROR_SQL = f"""
with s as (select project_name, cast(commit_count as double) v from file_facts where commit_count is not null),
r as (select project_name, v, row_number() over (partition by project_name order by v) k, count(*) over (partition by project_name) n from s)
select project_name, n, {', '.join(f"min(v) filter (where k >= greatest(1, ceil({p} * n - 1e-9))) {k}" for k, p in PERCENTILES.items())}
from r group by project_name, n
"""


def _components(spark: SparkSession, sf: str) -> DataFrame:
    return splits.name_components(table(spark, sf, "file_facts", "project_name"), "project_name", table(spark, sf, "project_aliases", "old_name", "new_name"), "old_name", "new_name")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of project names of file_facts that stand for the same project."""
    return splits.same_entity_pairs(_components(spark, sf))


def _sizes(spark: SparkSession, sf: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "file_facts", "project_name").groupBy("project_name").agg(F.count("*").alias("rows"))
    known = rows.join(found, F.col("project_name") == F.col("name"), "left").select("project_name", "rows", F.coalesce("component", F.lit(splits.NULL_ENTITY)).alias("component"))
    return known, known.groupBy("component").agg(F.sum("rows").alias("rows"))


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    """(project_name, component, split, rows) of file_facts: every spelling of a project in one split."""
    known, sizes = _sizes(spark, sf, _components(spark, sf))
    placed = splits.split_components(sizes, SHARES)
    return known.join(placed.select("component", "split"), "component").select("project_name", "component", "split", "rows")


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per run of the check that no recorded rename crosses a split: always 0 leaks."""
    placed = p6_splits(spark, sf).select(splits.canonical_name(F.col("project_name")).alias("c"), "split").where("c is not null").distinct()
    links = table(spark, sf, "project_aliases", "old_name", "new_name").select(splits.canonical_name(F.col("old_name")).alias("a"), splits.canonical_name(F.col("new_name")).alias("b")).distinct()
    a, b = placed.select(F.col("c").alias("a"), F.col("split").alias("sa")), placed.select(F.col("c").alias("b"), F.col("split").alias("sb"))
    return links.join(a, "a").join(b, "b").agg(F.coalesce(F.sum((F.col("sa") != F.col("sb")).cast("long")), F.lit(0)).cast("long").alias("leaks"))


QUERIES = {"p2_cutoffs": p2_cutoffs, "p4_percentiles": p4_percentiles, "p4_error": p4_error, "p6_found": p6_found, "p6_splits": p6_splits, "p6_leaks": p6_leaks}

_CANON = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^(([a-z][a-z0-9+]*://)([^@/]*@)?git\\.example\\.org/+|([^@/]+@)?git\\.example\\.org[:/]/*)', ''), '/+$', ''), '\\.git$', '')"
P6_SQL = f"""
with recursive names as (select distinct project_name n from file_facts where project_name is not null),
nodes as (select n, {_CANON.format('n')} c from names),
e as (select distinct {_CANON.format('old_name')} a, {_CANON.format('new_name')} b from project_aliases where old_name is not null and new_name is not null),
both_ as (select a, b from e union select b, a from e),
reach(s, t) as (select c, c from (select distinct c from nodes) union select r.s, b.b from reach r join both_ b on r.t = b.a)
select x.n name_a, y.n name_b from nodes x join reach on reach.s = x.c join nodes y on y.c = reach.t where x.n < y.n
"""
_CASES = " ".join(f"when middle < {sum(x for _, x in SHARES[:i + 1])}::double then '{label}'" for i, (label, _) in enumerate(SHARES[:-1]))
P6_SPLITS_SQL = P6_SQL.rsplit("select x.n name_a", 1)[0].rstrip() + f""",
comp as (select s c, min(t) component from reach group by s),
named as (select f.project_name, coalesce(component, '{splits.NULL_ENTITY}') component, count(*) n from file_facts f left join nodes on nodes.n = f.project_name left join comp on comp.c = nodes.c group by 1, 2),
sizes as (select component, sum(n) n from named group by 1),
placed as (select component, (coalesce(sum(n) over (order by md5(component), component rows between unbounded preceding and 1 preceding), 0) + n / 2.0::double) / sum(n) over () middle from sizes)
select project_name, component, case {_CASES} else '{SHARES[-1][0]}' end split, n "rows" from named join placed using (component)
"""
ORACLES = {"p6_splits": P6_SPLITS_SQL, "p2_cutoffs": P2_SQL, "p4_error": P4_ERROR_SQL, "p6_found": P6_SQL, "p6_leaks": "select cast(0 as bigint) leaks"}
