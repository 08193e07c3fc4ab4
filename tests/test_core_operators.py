from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from forgelens.functions import scalars, text
from forgelens.operators import dataset, history, labels, metrics, splits, stats

from .conftest import rows

FACTS = "file_path string, project_name string, commit_count int, smell_count int"


def facts(spark, smells, project="u/a"):
    return spark.createDataFrame([(f"{project}{i}", project, i, s) for i, s in enumerate(smells)], FACTS)


def test_smell_percentile_is_inclusive_and_per_project(spark):
    df = facts(spark, [1, 3, 5, 7, 9]).union(facts(spark, [10, 20, 30, 40, 50], "u/b"))
    assert rows(labels.smell_thresholds(df), "project_name", "threshold") == [("u/a", pytest.approx(7.4)), ("u/b", pytest.approx(42.0))]
    assert rows(labels.with_smell_binary(df).where("smell_binary = 1"), "smell_count") == [(9,), (50,)]


def test_smell_percentile_with_nulls_and_equal_counts(spark):
    nulls = spark.createDataFrame([("a", "p", 1, None), ("b", "p", 2, None)], FACTS)
    assert [r.smell_binary for r in labels.with_smell_binary(nulls).collect()] == [0, 0]
    assert [r.smell_binary for r in labels.with_smell_binary(facts(spark, [0, 0, 0])).collect()] == [1, 1, 1]
    assert labels.with_smell_binary(facts(spark, [1]).limit(0)).count() == 0


def test_commit_label_is_strict(spark):
    df = spark.createDataFrame([(str(i), "p", c, 0) for i, c in enumerate([1, 2, 3, 10, 100])], FACTS)
    assert rows(labels.with_commit_label(df), "commit_count", "label_commit") == [(1, 0), (2, 0), (3, 0), (10, 1), (100, 1)]
    skewed = spark.createDataFrame([(str(i), "p", c, 0) for i, c in enumerate([1, 1, 1, 1, 1, 1, 2, 5, 20])], FACTS)
    assert labels.with_commit_label(skewed).where("label_commit = 1").count() == 3


def test_ci_signals(spark):
    listing = spark.createDataFrame([("r", ".github/workflows", True), ("r", "compose.yml", False), ("s", "README.md", False), ("t", "docker-compose.dev.yaml", False), ("t", "Jenkinsfile", False)], "repo string, path string, is_dir boolean")
    got = {r.repo: r for r in labels.ci_signals(listing).collect()}
    assert got["r"].has_github_actions and got["r"].has_compose and not got["r"].has_travis
    assert not got["s"].is_devops_project
    assert got["t"].has_jenkins and got["t"].has_compose and got["t"].is_devops_project


@pytest.mark.parametrize(("message", "bug"), [("fix crash in parser", True), ("fix(core): x", True), ("closes #12", True), ("closes #12abc", True), ("encloses #12", False), ("prefix table", False), ("add feature", False), ("éfix", False), ("", False), (None, False)])
def test_bug_messages(spark, message, bug):
    assert spark.createDataFrame([(message,)], "m string").select(text.is_bug_message(F.col("m"))).first()[0] is bug


def test_message_groups_and_paths(spark):
    g = spark.createDataFrame([("fix bug and error in loop",)], "m string").select(*[c.alias(k) for k, c in text.bug_groups(F.col("m")).items()]).first().asDict()
    assert g == {"fix": 1, "bug": 1, "error": 1, "defect": 0, "issue": 0, "anomaly": 0}
    p = spark.createDataFrame([("src/latest_x.py",), ("a/tests/b.py",), ("tests/b.py",), ("src/a.py",), ("a/.hidden/b.py",)], "p string")
    assert [r[0] for r in p.select(text.should_skip(F.col("p"))).collect()] == [True, True, False, False, True]


def test_categories(spark):
    d = spark.createDataFrame([("x/y", ["security", "vulnerability"], None), ("a/b", ["machine learning"], ""), ("c/d", None, "rapidly growing capital"), ("django/django", [None], "")], "n string, t array<string>, d string")
    c = d.select(text.categories(text.category_text(F.col("n"), F.col("t"), F.col("d"))).alias("c"))
    assert [r.c[0] for r in c.collect()] == ["Security", "AI/ML", "Diger", "Web"]


def counts(spark, values):
    return spark.createDataFrame([("r", f"a{i}", v) for i, v in enumerate(values)], "repo string, author string, n long")


@pytest.mark.parametrize(("values", "expected"), [([10, 10, 10, 10], 0.0), ([1, 3], 0.25), ([1, 1, 1, 97], 0.72)])
def test_gini(spark, values, expected):
    v = sorted(values)
    n = len(v)
    exact = 2 * sum((i + 1) * x for i, x in enumerate(v)) / (n * sum(v)) - (n + 1) / n
    got = history.gini(counts(spark, values)).first().contribution_gini
    assert got == pytest.approx(exact, abs=1e-4) and got == pytest.approx(expected, abs=1e-4)


def test_entropy_and_cadence(spark):
    assert history.entropy(counts(spark, [5, 5])).first().author_entropy == 1.0
    assert history.entropy(counts(spark, [7])).first().author_entropy == 0.0
    c = spark.createDataFrame([("r", t) for t in (1000, 2000, 3000, 4000)] + [("s", t) for t in (0, 1, 2, 3, 103)] + [("t", 5)], "repo string, ts long")
    got = {r.repo: r.inter_commit_time_cv for r in history.cadence(c).collect()}
    assert got["r"] == 0 and got["s"] > 0.5 and got["t"] == 0


def test_bug_series(spark):
    s = spark.createDataFrame([("a", 1, 1), ("a", 4, 1), ("a", 7, 1), ("b", 2, 1), ("b", 9, 1), ("c", 0, 0)], "file string, idx int, is_intro int")
    r = history.bug_series_stats(s).first()
    assert (r.files_with_bug, r.mean_to_first, r.mean_between) == (2, 1.5, 4.33)
    e = history.bug_series_stats(s.limit(0)).first()
    assert (e.files_with_bug, e.mean_to_first, e.median_to_first, e.mean_between) == (0, 0, 0, 0)


def test_repo_summary_tolerates_bad_times(spark):
    now = 1_000_000_000
    log = spark.createDataFrame([("r", "d", "x", "fix crash"), ("r", "d", str(now - 10), "refactor it"), ("r", "e", str(now - 9_000_000), 'Revert "a"')], "repo string, author string, ts string, subject string")
    r = history.repo_summary(history.parsed_commits(log), now).first()
    assert (r.total_commits, r.bug_commits, r.refactor_commits, r.revert_count, r.recent_commits) == (3, 1, 1, 1, 1)


def test_sensitivity_keeps_empty_scenarios(spark):
    rows_ = [(c, l, s) for c, l, s in zip([1, 10, 25, 80, 100, 500], [0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 1, 1])]
    df = spark.createDataFrame([("p", *r) for r in rows_], "project_name string, commit_count int, label_commit int, smell_binary int")
    got = {(r.lo, r.hi): r.files for r in dataset.sensitivity(df, [(None, None), (10, 100), (10, 25), (900, None)]).collect()}
    assert got == {(None, None): 6, (10, 100): 4, (10, 25): 2, (900, None): 0}


def test_caps_thresholds_and_upserts(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(90)], "row_id long, project_name string")
    assert {r["project_name"]: r["n"] for r in dataset.capped(df, 7, "row_id").groupBy("project_name").agg(F.count("*").alias("n")).collect()} == {"big": 7, "small": 7}
    assert rows(dataset.capped(df, 7, "row_id"), "row_id") == rows(dataset.capped(df.repartition(7), 7, "row_id"), "row_id")
    assert dataset.enough_files(df, 31).select("project_name").distinct().count() == 1
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 3)], "k string, v int")
    assert rows(dataset.upsert(a, b, "k"), "k", "v") == [("x", 1), ("y", 3)]
    with pytest.raises(KeyError):
        dataset.extract_xy(df, ["nope"], "row_id")


def test_metrics_against_loops(spark):
    rnd = random.Random(3)
    data = [(int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(data, "y int, p double")
    f1 = {}
    for i in range(91):
        t = round(0.05 + 0.01 * i, 2)
        tp = sum(y == 1 and p >= t for y, p in data)
        f1[t] = round(2 * tp / max(1, sum(p >= t for _, p in data) + sum(y for y, _ in data)), 6)
    assert {r.threshold: r.f1 for r in metrics.threshold_sweep(df).collect()} == f1
    best = metrics.best_threshold(df).first()
    assert best.threshold == min(t for t in f1 if f1[t] == max(f1.values()))
    ap, pos = 0.0, sum(y for y, _ in data)
    for s in sorted({p for _, p in data}, reverse=True):
        seen = [y for y, p in data if p >= s]
        ap += sum(y for y, p in data if p == s) / pos * sum(seen) / len(seen)
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap, abs=1e-5)


def test_imbalanced_classification(spark):
    q = metrics.quadrants(spark.createDataFrame([(0, 0)] * 90 + [(1, 0)] * 10, "y int, yhat int"))
    m = metrics.classification(q).first()
    assert m.f1_binary == 0 and m.f1_weighted > 0.8 and m.f1_macro < 0.6 and m.mcc == 0


@pytest.mark.parametrize(("pairs", "expected"), [([(1, 1), (0, 0)], 1.0), ([(1, 0), (0, 1)], -1.0), ([(1, 1), (1, 1)], 1.0), ([], 0.0)])
def test_kappa(spark, pairs, expected):
    assert metrics.kappa(spark.createDataFrame(pairs, "a int, b int")).first().kappa == expected


def test_spearman_ranks(spark):
    data = [(float(i % 7), math.exp(i % 7), float(i)) for i in range(50)]
    got = {(r.feature_a, r.feature_b): r for r in metrics.correlations(spark.createDataFrame(data, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got[("a", "b")].spearman == 1.0 and got[("a", "b")].pearson < 1.0


def test_splits(spark):
    df = spark.createDataFrame([(f"p{i % 20}", i) for i in range(200)], "project_name string, row_id long")
    parts = splits.project_split(df)
    assert rows(parts.groupBy("part").count(), "part", "count") == [("test", 3), ("train", 14), ("validation", 3)]
    assert splits.overlap(parts).first().overlapping == 0
    with pytest.raises(ValueError, match="too few"):
        splits.project_split(df.where("project_name in ('p0', 'p1')"))
    folds = splits.group_folds(df, 5)
    assert rows(folds.groupBy("fold").count(), "fold", "count") == [(i, 4) for i in range(5)]


def test_time_split_puts_bad_dates_last(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i + 1:02d}" if i else None) for i in range(20)], "row_id long, d string").withColumn("ts", F.col("d").cast("timestamp"))
    got = {r.row_id: r.part for r in splits.time_split(df, "ts", "row_id").collect()}
    assert got[0] == "test" and got[1] == "train" and sum(p == "train" for p in got.values()) == 14


@pytest.mark.parametrize(("score", "tier"), [(0.10, "PASS"), (0.299, "PASS"), (0.30, "REVIEW"), (0.699, "REVIEW"), (0.70, "BLOCK"), (0.95, "BLOCK")])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(scalars.risk_tier(F.lit(score))).first()[0] == tier


def test_project_stats(spark):
    df = spark.createDataFrame(
        [("u/a", "Web", 100, 1, 0, 0, 5), ("u/a", "Web", 200, 2, 1, 1, 8), ("u/b", "AI/ML", 300, 3, 0, 0, -1), ("u/b", "AI/ML", 400, 4, 1, 0, 12), ("u/c", "Web", 500, 5, 1, 1, 3)],
        "project_name string, category_primary string, loc int, smell_count int, bug_keyword int, bug_szz int, commits_to_first_bug int",
    ).withColumns({"refactor_ratio": F.lit(0.1), "contribution_gini": F.lit(0.2)})
    got = {r.category: r for r in stats.project_stats(df).collect()}
    a = got["<all>"]
    assert (a.n_projects, a.n_files, a.total_loc, a.bug_keyword_rate, a.bug_szz_rate, a.avg_commits_to_first_bug) == (3, 5, 1500, 0.6, 0.4, 7.0)
    assert (got["Web"].n_files, got["Web"].n_projects) == (3, 2)


def test_age_of_every_project(spark, tmp_path):
    from forgelens.plans.dataset import pj10_age_days

    dates = [None, "", "unknown", "2025-13-45", "2025-03-22T10:00:00Z", "2025-04-01", "2026-01-01"]
    spark.createDataFrame(list(enumerate(dates)), "discovery_id long, created_at string").write.parquet(f"{tmp_path}/discovery.parquet")
    assert rows(pj10_age_days(spark, str(tmp_path)), "discovery_id", "age_days") == [(0, 365), (1, 365), (2, 365), (3, 365), (4, 10), (5, 1), (6, 1)]


def test_vocabulary_from_a_table(spark):
    words = spark.createDataFrame([("Web", "flask", 2), ("AI/ML", "machine-learning", 1), ("Web", "api", 2), (None, "x", 1), ("Web", None, 3)], "category string, word string, position int")
    v = text.vocabulary_of(words)
    assert v == {"AI/ML": ("machine-learning",), "Web": ("api", "flask")}
    df = spark.createDataFrame([("pallets/flask", None), ("a/b", "a machine learning tool with an API"), ("a/rapidly", "capital"), ("xyz123abc", None)], "name string, description string")
    got = [r[0] for r in df.select(text.categories(text.category_text(F.col("name"), None, F.col("description")), v)).collect()]
    assert got == [["Web"], ["AI/ML", "Web"], ["Diger"], ["Diger"]]


def test_trailing_counts_and_gaps_across_blocks(spark):
    day, rnd = 86400, random.Random(3)
    times = sorted(rnd.randrange(0, 400 * day) for _ in range(300)) + [10, 10]
    df = spark.createDataFrame([("r", t) for t in times] + [("s", 5), ("t", None)], "repo string, ts long")
    got = sorted((r.ts, r.trailing) for r in history.trailing_count(df).where("repo = 'r'").collect())
    assert got == sorted((t, sum(t - 90 * day <= u <= t for u in times)) for t in times)
    ordered = sorted(times)
    assert sorted(r.gap for r in history.gaps(df).where("repo = 'r' and gap is not null").collect()) == sorted(b - a for a, b in zip(ordered, ordered[1:]))


def test_failed_linter_output_has_a_null_count(spark):
    from forgelens.sources import readers

    out = spark.createDataFrame([(1, 'noise\n{"messages": [{"source": "a", "message": "x"}, {"source": "a", "message": "y"}, {"message": "z"}]}'), (2, "crashed"), (3, '{"messages": []}'), (4, None)], "id int, out string")
    assert sorted((tuple(r) for r in readers.linter_counts(out, "id", "out").collect()), key=str) == [(1, "a", 2), (1, "unknown", 1), (2, None, None), (4, None, None)]


def test_numstat_and_line_labels(spark):
    lines = spark.createDataFrame([(1, "3\t0\ta\\b.py"), (2, "-\t-\tx.bin"), (3, "no numstat"), (4, "1\t2\tc.py\textra"), (5, None)], "id int, line string")
    assert sorted(tuple(r) for r in history.parsed_numstat(lines, "line", "id").collect() if r.added) == [(1, 3.0, 0.0, "a/b.py")]
    assert history.parsed_numstat(lines, "line", "id").count() == 2
    t = spark.createDataFrame([("a", 1, "s1", 10, False), ("a", 1, "s2", 20, True), ("b", 1, "s2", 20, True), ("c", 1, "s2", 20, True), ("c", 2, "s1", 10, False), ("gone", 1, "s1", 1, False), ("gone", 1, "s2", 2, True)], "path string, line int, sha string, ts long, is_fix boolean")
    head = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    assert rows(history.line_labels(t, head), "path", "bug_szz") == [("a", 1), ("b", 0), ("c", 0), ("d", 0)]
