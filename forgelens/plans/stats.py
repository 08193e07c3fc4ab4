"""Queries of statistics, evaluation metrics, rankings and grids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions import scalars
from forgelens.operators import metrics, stats
from forgelens.plans.base import SCORES_SQL, Book, facts, scores
from forgelens.session import table

book = Book()

_STATS = """count(distinct project_name) n_projects, count(*) n_files, coalesce(sum(loc), 0)::bigint total_loc, round(coalesce(avg(commits_to_first_bug) filter (where commits_to_first_bug >= 0), 0), 2) avg_commits_to_first_bug,
 round(coalesce(median(1000.0::double * smell_count / nullif(loc, 0)), 0), 4) median_smell_density, round(coalesce(avg(cast(bug_keyword > 0 as int)::double), 0), 4) bug_keyword_rate, round(coalesce(avg(cast(bug_szz > 0 as int)::double), 0), 4) bug_szz_rate,
 round(coalesce(avg(refactor_ratio::double), 0), 4) avg_refactor_ratio, round(coalesce(avg(contribution_gini::double), 0), 4) avg_gini from file_facts"""
_STAT_COLUMNS = ("category_primary", "project_name", "loc", "smell_count", "bug_keyword", "bug_szz", "commits_to_first_bug", "refactor_ratio", "contribution_gini")


@book("ag8_project_stats", f"select '<all>' category, {_STATS} union all select coalesce(category_primary, '<null>') category, {_STATS} group by 1")
def ag8_project_stats(spark, sf):
    """AG9: global and by-category statistics."""
    return stats.project_stats(facts(spark, sf, *_STAT_COLUMNS))


@book("ag11_health", """select project_name, count(*) files, sum(loc) loc, sum(bug_count) bugs, sum(commit_count) commits, sum(coalesce(smell_count, 0)) smells, round(case when sum(loc) > 0 then sum(bug_count) / (sum(loc) / 1000.0::double) else 0 end, 2) defect_density,
 round(case when sum(loc) > 0 then sum(coalesce(smell_count, 0)) / (sum(loc) / 1000.0::double) else 0 end, 2) smell_density, round(sum(commit_count) / count(*)::double, 2) avg_commits_per_file, round(case when sum(commit_count) > 0 then sum(bug_count) / sum(commit_count)::double else 0 end, 4) bug_fix_ratio from file_facts group by project_name""")
def ag11_health(spark, sf):
    """AG12: health and smell summary per project."""
    return stats.project_health(facts(spark, sf, "project_name", "loc", "bug_count", "commit_count", "smell_count"))


@book("ag12_smell_summary", """with f as (select project_name, file_path, max(smell_count) smell_count, sum(loc) loc, max(bug_keyword) bug_pred, max(smell_binary) smell_pred from file_facts where file_path is not null group by 1, 2),
 t as (select project_name, string_agg(concat(file_path, ':', smell_count), ' ' order by smell_count desc, file_path) top_files from (select *, row_number() over (partition by project_name order by smell_count desc, file_path) r from f where smell_count > 0) where r <= 5 group by 1),
 g as (select project_name, sum(coalesce(smell_count, 0)) total_smells, round(case when sum(loc) > 0 then sum(coalesce(smell_count, 0)) / (sum(loc) / 1000.0::double) else 0 end, 2) smell_density, count(*) filter (where smell_pred = 1) smell_risk, count(*) filter (where smell_pred = 1 and bug_pred = 1) refactor_priority from f group by 1)
 select g.*, coalesce(top_files, '') top_files from g left join t on g.project_name is not distinct from t.project_name""")
def ag12_smell_summary(spark, sf):
    """Smell totals, density, risk and priority counts, and the five smelliest files of every project, by file."""
    f = facts(spark, sf, "project_name", "file_path", "loc", "smell_count", "bug_keyword", "smell_binary").where("file_path is not null")
    return stats.smell_summary(f.groupBy("project_name", "file_path").agg(F.max("smell_count").alias("smell_count"), F.sum("loc").alias("loc"), F.max("bug_keyword").alias("bug_pred"), F.max("smell_binary").alias("smell_pred")))


@book("ag13_tiers", f"with {SCORES_SQL}, c as (select case when p >= 0.7 then 'BLOCK' when p >= 0.3 then 'REVIEW' else 'PASS' end tier, count(*) n from scores group by 1) select t.tier, coalesce(n, 0) files from (values ('PASS'), ('REVIEW'), ('BLOCK')) t(tier) left join c using (tier)")
def ag13_tiers(spark, sf):
    return stats.tier_distribution(scores(spark, sf), "p")


@book("ag15_categories", "with d as (select project_name, min(coalesce(category_primary, '<null>')) v from file_facts group by project_name) select v as \"value\", count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 2) pct from d group by v")
def ag15_categories(spark, sf):
    """Categories at the grain of projects."""
    d = facts(spark, sf, "project_name", "category_primary").groupBy("project_name").agg(F.min(F.coalesce("category_primary", F.lit("<null>"))).alias("v"))
    return stats.distribution(d, "v")


@book("ag16_summary", "".join(f"{' union all ' if i else ''}select '{c}' as \"column\", count({c}) n, count(*) - count({c}) nulls, round(avg({c}::double), 4) mean, median({c}::double) median, max({c}::double) max from file_facts" for i, c in enumerate(("loc", "commit_count", "smell_count", "cc_mean"))))
def ag16_summary(spark, sf):
    return stats.column_summary(facts(spark, sf, "loc", "commit_count", "smell_count", "cc_mean"), ["loc", "commit_count", "smell_count", "cc_mean"])


_RUNS = "runs as (select case o_orderstatus when 'F' then 'ok' when 'O' then 'failed' else 'skipped' end status, round(o_totalprice / 1000, 2) secs from orders)"


@book("ag17_runs", f"with {_RUNS} select status, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 2) pct, round(avg(secs), 2) avg_seconds, sum(case when status <> 'ok' then count(*) else 0 end) over () > 0.1 * sum(count(*)) over () many_failures from runs group by status")
def ag17_runs(spark, sf):
    """FL8: runs by status, with duration and a warning."""
    o = table(spark, sf, "orders", "o_orderstatus", "o_totalprice")
    s = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return stats.run_totals(o.select(s.alias("status"), F.round(F.col("o_totalprice") / 1000, 2).alias("seconds")))


_Q = f"{SCORES_SQL}, q as (select count(*) filter (where y = 0 and p < 0.42) tn, count(*) filter (where y = 0 and p >= 0.42) fp, count(*) filter (where y = 1 and p < 0.42) fn, count(*) filter (where y = 1 and p >= 0.42) tp from scores)"


def _predicted(spark, sf):
    return scores(spark, sf).withColumn("yhat", scalars.predicted(F.col("p"), scalars.BUG_THRESHOLD))


@book("ag19_quadrants", f"with {_Q} select tn, fp, fn, tp from q")
def ag19_quadrants(spark, sf):
    """PJ16: confusion quadrants at the production threshold."""
    return metrics.quadrants(_predicted(spark, sf))


@book("pj24_error_class", f"with {SCORES_SQL} select row_id, case when y = 0 and p < 0.42 then 'tn' when y = 0 then 'fp' when p < 0.42 then 'fn' else 'tp' end error_class from scores")
def pj24_error_class(spark, sf):
    d = _predicted(spark, sf)
    return d.select("row_id", scalars.error_class(F.col("y"), F.col("yhat")).alias("error_class"))


@book("ag21_metrics", f"""with {_Q}, m as (select tn::double tn, fp::double fp, fn::double fn, tp::double tp from q), f as (select *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) f0, tn + fp + fn + tp n from m)
 select round(f1, 6) f1_binary, round(coalesce((f1 * (tp + fn) + f0 * (tn + fp)) / nullif(n, 0), 0), 6) f1_weighted, round((f1 + f0) / 2, 6) f1_macro, round(coalesce((tp + tn) / nullif(n, 0), 0), 6) accuracy,
 round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) mcc, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) recall from f""")
def ag21_metrics(spark, sf):
    """AG23: F1, accuracy, Matthews correlation, precision, recall."""
    return metrics.classification(metrics.quadrants(_predicted(spark, sf)))


_SWEEP = f"{SCORES_SQL}, g as (select round(0.05 + 0.01 * i, 2)::double threshold from range(91) r(i)), s as (select threshold, round(coalesce(2.0::double * count(*) filter (where y = 1 and p >= threshold) / nullif(count(*) filter (where p >= threshold) + count(*) filter (where y = 1), 0), 0), 6) f1 from g cross join scores group by threshold)"


@book("ag20_threshold_sweep", f"with {_SWEEP} select threshold, f1 from s")
def ag20_threshold_sweep(spark, sf):
    """91 thresholds from one histogram of scores."""
    return metrics.threshold_sweep(scores(spark, sf))


@book("tk4_best_threshold", f"with {_SWEEP} select threshold, f1 from s order by f1 desc, threshold limit 1")
def tk4_best_threshold(spark, sf):
    return metrics.best_threshold(scores(spark, sf))


_PR = f"{SCORES_SQL}, g as (select p score, sum(y)::double pos, count(*)::double n from scores group by p), c as (select score, pos, sum(pos) over (order by score desc) tp, sum(n) over (order by score desc) seen, sum(pos) over () positives from g)"


@book("wn9_pr_curve", f"with {_PR} select score, round(tp / seen, 6) \"precision\", round(tp / positives, 6) recall from c")
def wn9_pr_curve(spark, sf):
    """Cumulative precision and recall at every score."""
    return metrics.pr_curve(scores(spark, sf)).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@book("ag22_average_precision", f"with {_PR} select round(sum(tp / seen * pos / positives), 6) average_precision from c")
def ag22_average_precision(spark, sf):
    return metrics.average_precision(scores(spark, sf))


@book("ag24_kappa", """with s as (select count(*)::double n, count(*) filter (where a = b) same, sum(a)::double sa, sum(b)::double sb from (select cast(bug_keyword as int) a, cast(bug_szz as int) b from file_facts where bug_keyword is not null and bug_szz is not null)),
 k as (select n, same / n po, sa / n * sb / n + (1 - sa / n) * (1 - sb / n) pe from s), r as (select n::bigint n, round(case when pe >= 1 then 1.0::double else (po - pe) / (1 - pe) end, 6) kappa from k)
 select n, kappa, case when kappa < 0 then 'Poor (<0)' when kappa < 0.2 then 'Slight (0–0.20)' when kappa < 0.4 then 'Fair (0.20–0.40)' when kappa < 0.6 then 'Moderate (0.40–0.60)' when kappa < 0.8 then 'Substantial (0.60–0.80)' else 'Almost Perfect (0.80–1.0)' end band from r""")
def ag24_kappa(spark, sf):
    """JN17, PJ25: agreement of two labels where both are there."""
    f = facts(spark, sf, "bug_keyword", "bug_szz").select(F.col("bug_keyword").cast("int").alias("a"), F.col("bug_szz").cast("int").alias("b"))
    return metrics.kappa(f).withColumn("band", scalars.kappa_band(F.col("kappa")))


_FEATURES = ["loc", "cc_total", "n_authors", "h_volume"]


def _corr_sql() -> str:
    ranks = ", ".join(f"rank() over (order by {c}::double) + (count(*) over (partition by {c}) - 1) / 2.0::double r_{c}" for c in _FEATURES)
    cols = ", ".join(f"{c}::double {c}" for c in _FEATURES)
    nn = " and ".join(f"{c} is not null" for c in _FEATURES)
    pairs = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1:]]
    return f"with r as (select {cols}, {ranks} from file_facts where {nn}) " + " union all ".join(
        f"select '{a}' feature_a, '{b}' feature_b, round(abs(corr({a}, {b})), 5) pearson, round(abs(corr(r_{a}, r_{b})), 5) spearman, round((abs(corr({a}, {b})) + abs(corr(r_{a}, r_{b}))) / 2, 5) mean_abs from r" for a, b in pairs)


@book("ag25_correlations", _corr_sql())
def ag25_correlations(spark, sf):
    """WN10: Pearson and Spearman of every pair of features."""
    return metrics.correlations(facts(spark, sf, *_FEATURES).na.drop(), _FEATURES)


def _runs(spark):
    """A small ablation table: a literal of results per model, feature set and fold."""
    rows = [(m, fs, fold, round(0.4 + 0.03 * i + 0.02 * j + 0.005 * fold, 4), round(0.5 + 0.02 * i + 0.01 * fold, 4)) for i, m in enumerate(("lr", "rf", "gbt")) for j, fs in enumerate(("static", "process", "all")) for fold in range(5)]
    return spark.createDataFrame(rows, "model string, feature_set string, fold int, f1 double, mcc double")


_RUNS_SQL = "runs as (select m model, fs feature_set, fold::int fold, round(0.4 + 0.03 * i + 0.02 * j + 0.005 * fold, 4)::double f1, round(0.5 + 0.02 * i + 0.01 * fold, 4)::double mcc from (values ('lr', 0), ('rf', 1), ('gbt', 2)) a(m, i), (values ('static', 0), ('process', 1), ('all', 2)) b(fs, j), range(5) c(fold))"


@book("ag18_fold_summary", f"with {_RUNS_SQL}, l as (select model, fold, 'f1' metric, f1 v from runs where feature_set = 'all' union all select model, fold, 'mcc', mcc from runs where feature_set = 'all') select model, metric, round(avg(v), 4) mean, round(stddev_pop(v), 4) std, count(*) folds from l group by model, metric")
def ag18_fold_summary(spark, sf):
    s = metrics.fold_summary(_runs(spark).where("feature_set = 'all'"), ["f1", "mcc"])
    return s.select("model", "metric", "mean", "std", F.size(F.split("values", ",")).cast("bigint").alias("folds"))


@book("ag26_best_scores", f"with {_RUNS_SQL} select model, max(f1) f1, max(mcc) mcc from runs group by model")
def ag26_best_scores(spark, sf):
    return _runs(spark).groupBy("model").agg(F.max("f1").alias("f1"), F.max("mcc").alias("mcc"))


@book("ag27_pivot", f"with {_RUNS_SQL} select model, round(avg(f1) filter (where feature_set = 'static'), 6) static, round(avg(f1) filter (where feature_set = 'process'), 6) process, round(avg(f1) filter (where feature_set = 'all'), 6) \"all\" from runs group by model")
def ag27_pivot(spark, sf):
    sets = ["static", "process", "all"]
    return _runs(spark).groupBy("model").pivot("feature_set", sets).agg(F.avg("f1")).select("model", *[F.round(s, 6).alias(s) for s in sets])


@book("tk2_top_runs", f"with {_RUNS_SQL} select model, feature_set, fold, f1 from runs order by f1 desc, model, feature_set, fold limit 10")
def tk2_top_runs(spark, sf):
    return stats.top_k(_runs(spark).select("model", "feature_set", "fold", "f1"), [F.desc("f1"), F.asc("model"), F.asc("feature_set"), F.asc("fold")], 10)


@book("wn11_best_per_model", f"with {_RUNS_SQL} select model, feature_set, fold, f1 from runs qualify row_number() over (partition by model order by f1 desc, feature_set, fold) = 1")
def wn11_best_per_model(spark, sf):
    return stats.best_per(_runs(spark).select("model", "feature_set", "fold", "f1"), "model", [F.desc("f1"), F.asc("feature_set"), F.asc("fold")])


@book("ag28_error_means", f"with {SCORES_SQL} select case when y = 0 and p < 0.42 then 'tn' when y = 0 then 'fp' when p < 0.42 then 'fn' else 'tp' end error_class, count(*) n, round(avg(loc), 2) mean_loc, round(avg(cc_mean::double), 2) mean_cc from scores join file_facts using (row_id) group by 1")
def ag28_error_means(spark, sf):
    d = _predicted(spark, sf).join(facts(spark, sf, "row_id", "loc", "cc_mean"), "row_id")
    return d.groupBy(scalars.error_class(F.col("y"), F.col("yhat")).alias("error_class")).agg(F.count("*").alias("n"), F.round(F.avg("loc"), 2).alias("mean_loc"), F.round(F.avg(F.col("cc_mean").cast("double")), 2).alias("mean_cc"))


_IMPORTANCE = "imp as (select f feature, fold, (x * 0.1 + fold * 0.001)::double importance from (values ('loc', 4), ('cc_max', 3), ('n_authors', 2), ('doc_ratio', 1)) a(f, x), range(5) c(fold))"


@book("ag31_importance", f"with {_IMPORTANCE}, g as (select feature, avg(importance) m, stddev_pop(importance) s from imp group by feature) select feature, round(m, 6) mean, round(s, 6) std, round(sum(m) over (order by m desc, feature) / sum(m) over (), 6) cumulative, coalesce(sum(m) over (order by m desc, feature rows between unbounded preceding and 1 preceding), 0) / sum(m) over () < 0.95 kept from g")
def ag31_importance(spark, sf):
    """TK6, ML17: importances over folds and what reaches 95 percent."""
    rows = [(f, fold, x * 0.1 + fold * 0.001) for f, x in (("loc", 4), ("cc_max", 3), ("n_authors", 2), ("doc_ratio", 1)) for fold in range(5)]
    return stats.importance_summary(spark.createDataFrame(rows, "feature string, fold int, importance double"))


@book("tk6_top_importances", f"with {_IMPORTANCE} select feature, round(avg(importance), 6) mean from imp group by feature order by avg(importance) desc, feature limit 20")
def tk6_top_importances(spark, sf):
    """The 20 most important features."""
    return stats.top_k(ag31_importance(spark, sf).select("feature", "mean"), [F.desc("mean"), F.asc("feature")], 20)


@book("ag32_linter", "select json_extract_string(props, '$.k') k, event_type, count(*) n from events group by 1, 2")
def ag32_linter(spark, sf):
    """SC21: messages by source from JSON."""
    return table(spark, sf, "events", "props", "event_type").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"))


@book("tk1_by_risk", f"with {SCORES_SQL} select row_id, p, rank() over (order by p desc) r from scores order by p desc, row_id limit 50")
def tk1_by_risk(spark, sf):
    """Riskiest files first; rank by counting higher scores."""
    s = scores(spark, sf)
    top = stats.top_k(s.select("row_id", "p"), [F.desc("p"), F.asc("row_id")], 50)
    return top.withColumn("r", F.rank().over(Window.orderBy(F.desc("p"))))


@book("tk3_smelliest", "select row_id, smell_count from file_facts where smell_count > 0 order by smell_count desc, row_id limit 5")
def tk3_smelliest(spark, sf):
    return stats.top_k(facts(spark, sf, "row_id", "smell_count").where("smell_count > 0"), [F.desc("smell_count"), F.asc("row_id")], 5)


@book("tk8_target_count", "select discovery_id, stars from discovery order by stars desc nulls last, discovery_id limit 100")
def tk8_target_count(spark, sf):
    return stats.top_k(table(spark, sf, "discovery", "discovery_id", "stars"), [F.desc_nulls_last("stars"), F.asc("discovery_id")], 100)


@book("tk9_evicted", "with t as (select event_id task_id, ts created_at from events), m as (select max(ts) a from events) select task_id from t, m where date_diff('second', created_at, a) <= 86400 order by created_at desc, task_id limit 200")
def tk9_evicted(spark, sf):
    """Tasks kept by age and number; the newest time stands for now."""
    t = table(spark, sf, "events", F.col("event_id").alias("task_id"), F.col("ts").cast("timestamp").alias("created_at"))
    now = t.agg(F.max("created_at")).first()[0]
    return stats.evicted(t, str(now), 86400, 200).select("task_id")


@book("tk10_page", "select row_id from file_facts order by loc desc nulls last, row_id limit 25 offset 50")
def tk10_page(spark, sf):
    return facts(spark, sf, "row_id", "loc").orderBy(F.desc_nulls_last("loc"), "row_id").offset(50).limit(25).select("row_id")


@book("ml1_scaled", "with s as (select avg(loc::double) m, stddev_pop(loc::double) s from file_facts) select row_id, round((loc - m) / s, 5) scaled from file_facts, s where loc is not null")
def ml1_scaled(spark, sf):
    """Standard scaling with population deviation."""
    f = facts(spark, sf, "row_id", "loc").where("loc is not null")
    s = f.agg(F.avg(F.col("loc").cast("double")).alias("m"), F.stddev_pop(F.col("loc").cast("double")).alias("s"))
    return f.crossJoin(F.broadcast(s)).select("row_id", F.round((F.col("loc") - F.col("m")) / F.col("s"), 5).alias("scaled"))  # one row of statistics


# The lists of the experiment matrix. Small feature sets are run with the small models only.
_TASKS = ("keyword", "szz", "p80")
_FEATURE_SETS = ("static", "derived", "process", "all")
_SPLITS = ("project", "time")
_MODELS = ("lr", "rf", "svm", "xgboost", "lightgbm", "autogluon", "h2o", "tpot", "mlp", "cnn1d", "lstm", "stacking_rf_ag_meta_lr")
_SMALL_MODELS = ("rf", "autogluon", "stacking_rf_ag_meta_lr")


def _unnested(name: str, values: tuple[str, ...]) -> str:
    return f"(select unnest([{', '.join(repr(v) for v in values)}]) {name})"


@book("ml15_combos", f"select task, feature_set, split, model from {_unnested('task', _TASKS)}, {_unnested('feature_set', _FEATURE_SETS)}, {_unnested('split', _SPLITS)}, {_unnested('model', _MODELS)} where feature_set = 'all' or list_contains([{', '.join(repr(v) for v in _SMALL_MODELS)}], model)")
def ml15_combos(spark, sf):
    """The pruned matrix of experiments, 126 of them: a product of short literal lists."""
    d = spark.range(1)
    for c, values in {"task": _TASKS, "feature_set": _FEATURE_SETS, "split": _SPLITS, "model": _MODELS}.items():
        d = d.withColumn(c, F.explode(F.array(*[F.lit(v) for v in values])))
    return d.where((F.col("feature_set") == "all") | F.col("model").isin(*_SMALL_MODELS)).drop("id")


# Least files of a project and caps of the sensitivity grid; null is no cap.
_LEAST, _CAPS = (1, 3, 5, 8, 10, 12, 15, 20, 25, 30, 40, 50), (None, 20, 30, 40, 50, 60, 75, 80, 100, 120, 150, 200, 300)


@book("ml19_grid", f"""with g(lo, hi) as (select a.x, b.x from (select unnest({list(_LEAST)}) x) a, (select unnest({str(list(_CAPS)).replace('None', 'null')}) x) b), n as (select project_name, count(*) c from file_facts group by project_name)
 select lo, hi, case when hi is not null and lo >= hi then null else coalesce((select sum(least(c, coalesce(hi, c))) from n where c >= lo), 0) end::bigint files from g""")
def ml19_grid(spark, sf):
    """Files left by every pair of least files and cap; impossible pairs are null."""
    n = facts(spark, sf, "project_name").groupBy("project_name").agg(F.count("*").alias("c"))
    grid = [(lo, hi) for lo in _LEAST for hi in _CAPS]
    sums = n.agg(*[F.coalesce(F.sum(F.when(F.col("c") >= lo, F.least("c", F.lit(hi)) if hi else F.col("c"))), F.lit(0)).alias(f"g{i}") for i, (lo, hi) in enumerate(grid)])
    cells = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).cast("int").alias("hi"), (F.lit(None).cast("bigint") if hi and lo >= hi else F.col(f"g{i}")).alias("files")) for i, (lo, hi) in enumerate(grid)])
    return sums.select(F.explode(cells).alias("x")).select("x.*")
