"""Queries over the file-fact table: labels, filters, joins, caps, upserts, splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from forgelens.functions import scalars, text
from forgelens.operators import dataset, labels, splits, stats
from forgelens.plans.base import AS_OF_DATE, Book, facts
from forgelens.session import table

book = Book()

_P80 = "t as (select project_name, quantile_cont(smell_count, 0.8) threshold from file_facts where smell_count is not null group by project_name)"


@book("ag6_smell_binary", f"with {_P80} select row_id, cast(coalesce(smell_count >= threshold, false) as tinyint) smell_binary from file_facts f left join t on f.project_name is not distinct from t.project_name")
def ag6_smell_binary(spark, sf):
    """LB3, WN1: per-project 80th percentile, inclusive."""
    return labels.with_smell_binary(facts(spark, sf, "row_id", "project_name", "smell_count")).select("row_id", "smell_binary")


@book("ag7_label_commit", "select row_id, cast(coalesce(commit_count > (select median(commit_count) from file_facts), false) as tinyint) label_commit from file_facts")
def ag7_label_commit(spark, sf):
    """LB2: strictly above the global median."""
    return labels.with_commit_label(facts(spark, sf, "row_id", "commit_count")).select("row_id", "label_commit")


_SCENARIOS = ((None, None), (10, 80), (25, None), (1000000000, 1000000001))


@book("ag10_sensitivity", f"""with {_P80}, l as (select f.project_name, commit_count, cast(coalesce(commit_count > (select median(commit_count) from file_facts), false) as int) label_commit, cast(coalesce(smell_count >= threshold, false) as int) smell_binary
 from file_facts f left join t on f.project_name is not distinct from t.project_name),
 s(lo, hi) as (values (null::int, null::int), (10, 80), (25, null), (1000000000, 1000000001))
 select lo, hi, case when lo is null and hi is null then 'filtresiz' else concat(coalesce(lo::varchar, '0'), '-', coalesce(hi::varchar, 'max')) end scenario, count(l.label_commit) files, count(distinct project_name) projects, round(100 * avg(label_commit::double), 2) pct_label_pos, round(100 * avg(smell_binary::double), 2) pct_smell_pos
 from s left join l on (lo is null or commit_count >= lo) and (hi is null or commit_count <= hi) group by lo, hi""")
def ag10_sensitivity(spark, sf):
    """PJ26: label rates of several commit-count filters, empty ones kept."""
    f = labels.with_commit_label(labels.with_smell_binary(facts(spark, sf, "row_id", "project_name", "smell_count", "commit_count")))
    return dataset.sensitivity(f, _SCENARIOS).withColumn("scenario", scalars.sensitivity_label(F.col("lo"), F.col("hi")))


_SIGNALS = ["has_github_actions", "has_travis", "has_jenkins", "has_gitlab_ci", "has_dockerfile", "has_compose", "has_pre_commit"]


@book("lb5_ci_signals", """with d as (select distinct project_name repo, has_github_actions a, has_travis t, has_jenkins j, has_gitlab_ci g, has_dockerfile d, has_compose c, has_pre_commit p from file_facts where project_name is not null)
 select repo, bool_or(coalesce(a, false)) has_github_actions, bool_or(coalesce(t, false)) has_travis, bool_or(coalesce(j, false)) has_jenkins, bool_or(coalesce(g, false)) has_gitlab_ci, bool_or(coalesce(d, false)) has_dockerfile,
 bool_or(coalesce(c, false)) has_compose, bool_or(coalesce(p, false)) has_pre_commit, bool_or(coalesce(a, false) or coalesce(t, false) or coalesce(j, false) or coalesce(g, false) or coalesce(d, false) or coalesce(c, false) or coalesce(p, false)) is_devops_project from d group by repo""")
def lb5_ci_signals(spark, sf):
    """Signals recovered from a listing; each project's listing is spelled out from its recorded flags."""
    f = facts(spark, sf, "project_name", *_SIGNALS).where("project_name is not null").distinct()
    files = {"has_travis": ".travis.yml", "has_jenkins": "Jenkinsfile", "has_gitlab_ci": ".gitlab-ci.yml", "has_dockerfile": "Dockerfile", "has_compose": "docker-compose.prod.yml", "has_pre_commit": ".pre-commit-config.yaml"}
    entry = lambda p, d: F.struct(F.lit(p).alias("path"), F.lit(d).alias("is_dir"))
    items = F.array(entry("README.md", False), F.when(F.col("has_github_actions"), entry(labels.WORKFLOWS, True)), *[F.when(F.col(c), entry(p, False)) for c, p in files.items()])
    listing = f.select(F.col("project_name").alias("repo"), F.explode(F.filter(items, lambda x: x.isNotNull())).alias("x")).select("repo", "x.path", "x.is_dir").distinct()
    return labels.ci_signals(listing)


@book("sc2_union", "select (select count(*) from file_facts) + (select count(*) from source_files) n, (select count(*) from file_facts where loc is not null) with_loc, (select count(*) from source_files where content is not null) with_content")
def sc2_union(spark, sf):
    """ST1: union by name; a column missing on one side is null there."""
    u = dataset.union_all([facts(spark, sf, "project_name", "file_path", "loc"), table(spark, sf, "source_files", "project_name", "file_path", "content")])
    return u.agg(F.count("*").alias("n"), F.count("loc").alias("with_loc"), F.count("content").alias("with_content"))


@book("sc3_project_names", "select distinct project_name from file_facts where project_name is not null")
def sc3_project_names(spark, sf):
    """DD1: the distinct project names; the scan reads one column."""
    return facts(spark, sf, "project_name").na.drop().distinct()


@book("sc4_latest_collection", "select row_id from file_facts where cast(loaded_at as date) = (select max(cast(loaded_at as date)) from file_facts)")
def sc4_latest_collection(spark, sf):
    """Rows of the latest load day."""
    f = facts(spark, sf, "row_id", "loaded_at").withColumn("day", F.to_date("loaded_at"))
    return f.join(F.broadcast(f.agg(F.max("day").alias("day"))), "day", "left_semi").select("row_id")


@book("sc10_head_python", "select distinct file_path from source_files where file_path like '%.py'")
def sc10_head_python(spark, sf):
    return table(spark, sf, "source_files", "file_path").where(F.col("file_path").endswith(".py")).distinct()


@book("sc12_source_text", "select file_id, cast(length(coalesce(content, '')) as bigint) characters, cast(case when content is null then 0 else length(content) - length(replace(content, chr(10), '')) end as bigint) newlines from source_files")
def sc12_source_text(spark, sf):
    c = F.coalesce("content", F.lit(""))
    return table(spark, sf, "source_files", "file_id", "content").select("file_id", F.length(c).cast("long").alias("characters"), (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("long").alias("newlines"))


@book("pj5_skip_file", "select file_id, regexp_matches(file_path, '" + text.SKIP_PATTERN + "') skip from source_files where file_path is not null")
def pj5_skip_file(spark, sf):
    """FL5: paths left out of analysis."""
    return table(spark, sf, "source_files", "file_id", "file_path").where("file_path is not null").select("file_id", text.should_skip(F.col("file_path")).alias("skip"))


def _cat_sql(haystack: str) -> str:
    each = ", ".join(f"case when regexp_matches({haystack}, '{text.category_pattern(w)}') then '{c}' end" for c, w in text.CATEGORIES.items())
    return f"list_filter([{each}], lambda x: x is not null)"


_HAY = "lower(concat_ws(' ', coalesce(array_to_string(topics, ' '), ''), coalesce(description, ''), coalesce(replace(replace(full_name, '-', ' '), '_', ' '), '')))"
_CATS = f"select discovery_id, full_name, {_cat_sql(_HAY)} c from discovery"


@book("pj6_categories", f"with c as ({_CATS}) select discovery_id, case when len(c) = 0 then 'Diger' else array_to_string(c, ',') end categories_all, coalesce(c[1], 'Diger') category_primary from c")
def pj6_categories(spark, sf):
    """PJ7, LB6: all categories of a project and the first."""
    d = table(spark, sf, "discovery", "discovery_id", "full_name", "topics", "description")
    cats = text.categories(text.category_text(F.col("full_name"), F.col("topics"), F.col("description")))
    return d.select("discovery_id", cats.alias("c")).select("discovery_id", F.array_join("c", ",").alias("categories_all"), text.primary_category(F.col("c")).alias("category_primary"))


@book("pj8_repo_name", "with t as (select discovery_id, regexp_replace(regexp_replace(clone_url, '/+$', ''), '[.]git$', '') u from discovery where clone_url is not null), s as (select discovery_id, regexp_replace(regexp_replace(string_split(u, '/')[-1], '[^a-zA-Z0-9_-]', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') n from t) select discovery_id, case when n = '' then 'repo' else n end repo_name from s")
def pj8_repo_name(spark, sf):
    return table(spark, sf, "discovery", "discovery_id", "clone_url").where("clone_url is not null").select("discovery_id", text.safe_repo_name(F.col("clone_url")).alias("repo_name"))


@book("pj9_full_name", "select discovery_id, nullif(regexp_extract(clone_url, '[/:]([\\w.-]+/[\\w.-]+?)(?:\\.git)?/?$', 1), '') full_name_found, regexp_matches(coalesce(clone_url, ''), '^https?://(www\\.)?git[.]example[.]org/[\\w.-]+/[\\w.-]+/?$') is_url from discovery where clone_url is not null")
def pj9_full_name(spark, sf):
    d = table(spark, sf, "discovery", "discovery_id", "clone_url").where("clone_url is not null")
    return d.select("discovery_id", text.full_name_of(F.col("clone_url")).alias("full_name_found"), text.is_repo_url(F.col("clone_url")).alias("is_url"))


@book("pj10_age_days", f"select discovery_id, coalesce(case when d is not null then greatest(d, 1) end, 365) age_days from (select discovery_id, date_diff('day', try_strptime(substr(created_at, 1, 10), '%Y-%m-%d')::date, date '{AS_OF_DATE}') d from discovery)")
def pj10_age_days(spark, sf):
    """Days since the project began, at least 1; 365 where the date is missing or cannot be read."""
    d = table(spark, sf, "discovery", "discovery_id", "created_at")
    return d.select("discovery_id", scalars.age_days(F.col("created_at"), AS_OF_DATE).cast("bigint").alias("age_days"))


@book("pj11_qualifiers", f"select n, strftime(date '{AS_OF_DATE}' - cast(n as int), '%Y-%m-%d') cut, format('language:Python created:<{{}} stars:>={{}}', strftime(date '{AS_OF_DATE}' - cast(n as int), '%Y-%m-%d'), n) qualifier from range(7, 70, 7) t(n)")
def pj11_qualifiers(spark, sf):
    """SC14: weekly search windows."""
    cut = F.date_format(F.date_sub(F.lit(AS_OF_DATE).cast("date"), F.col("n").cast("int")), "yyyy-MM-dd")
    return spark.range(7, 70, 7).withColumnRenamed("id", "n").select("n", cut.alias("cut"), F.format_string("language:Python created:<%s stars:>=%d", cut, F.col("n")).alias("qualifier"))


@book("pj12_normalised_path", "select file_id, replace(replace(file_path, '/', chr(92)), chr(92), '/') path from source_files")
def pj12_normalised_path(spark, sf):
    return table(spark, sf, "source_files", "file_id", "file_path").select("file_id", text.normalised_path(F.translate("file_path", "/", "\\")).alias("path"))


@book("pj13_derived", "select row_id, round(comments / greatest(loc::double, 1), 6) comment_ratio_new, round((single_comments + multi) / greatest(loc::double, 1), 6) doc_ratio_new, round(cc_total / greatest(num_functions::double, 1), 6) complexity_density_new, round(comments / greatest(num_functions::double, 1), 6) comment_per_function_new, round(loc / greatest(num_functions::double, 1), 6) avg_function_length_new from file_facts")
def pj13_derived(spark, sf):
    f = facts(spark, sf, "row_id", "comments", "loc", "single_comments", "multi", "cc_total", "num_functions")
    r = lambda a, b, n: F.round(scalars.ratio(a, F.col(b)), 6).alias(n)
    return f.select("row_id", r(F.col("comments"), "loc", "comment_ratio_new"), r(F.col("single_comments") + F.col("multi"), "loc", "doc_ratio_new"), r(F.col("cc_total"), "num_functions", "complexity_density_new"), r(F.col("comments"), "num_functions", "comment_per_function_new"), r(F.col("loc"), "num_functions", "avg_function_length_new"))


@book("pj14_bug_fix_density", "select project_name, round(sum(bug_count) / greatest(sum(loc) / 1000.0::double, 0.1) / greatest(greatest(max(project_age_days), 1) / 365.0::double, 0.1), 6) density from file_facts group by project_name")
def pj14_bug_fix_density(spark, sf):
    g = facts(spark, sf, "project_name", "bug_count", "loc", "project_age_days").groupBy("project_name").agg(F.sum("bug_count").alias("b"), F.sum("loc").alias("l"), F.max("project_age_days").alias("d"))
    return g.select("project_name", F.round(scalars.bug_fix_density(F.col("b"), F.col("l") / 1000.0, F.greatest("d", F.lit(1)) / 365.0), 6).alias("density"))


@book("pj17_coerced", "select row_id, cast(coalesce(try_cast(commit_count as int), 0) as int) commit_count, coalesce(description, '') description, smell_count, coalesce(has_travis, false) has_travis, cast(coalesce(file_age_days, 0) as double) file_age_days from file_facts")
def pj17_coerced(spark, sf):
    """Types with their null policy."""
    f = facts(spark, sf, "row_id", "commit_count", "description", "smell_count", "has_travis", "file_age_days")
    return dataset.coerced(f, {"commit_count": "int", "description": "string", "smell_count": "int", "has_travis": "boolean", "file_age_days": "double"}, nullable=("smell_count",))


@book("pj19_features", "select coalesce(loc::double, 0) loc, coalesce(cc_mean::double, 0) cc_mean, 0.0::double not_there, coalesce(smell_count::double, 0) smell_count from file_facts")
def pj19_features(spark, sf):
    return dataset.feature_frame(facts(spark, sf, "loc", "cc_mean", "smell_count"), ["loc", "cc_mean", "not_there", "smell_count"])


@book("pj20_extract_xy", "select coalesce(loc::double, 0) loc, coalesce(n_authors::double, 0) n_authors, coalesce(cast(bug_szz as bigint), 0) label from file_facts")
def pj20_extract_xy(spark, sf):
    return dataset.extract_xy(facts(spark, sf, "loc", "n_authors", "bug_szz"), ["loc", "n_authors"], "bug_szz")


@book("pj22_serving", """select row_id, round(least(1.0::double, loc / 1000.0::double), 4) bug_prob, round(cc_mean::double, 2) cc_mean, round(maintainability_index::double, 1) mi,
 case when least(1.0::double, loc / 1000.0::double) >= 0.7 then 'BLOCK' when least(1.0::double, loc / 1000.0::double) >= 0.3 then 'REVIEW' else 'PASS' end risk_tier, coalesce(smell_long_method, 0) + coalesce(smell_god_function, 0) smell_sum from file_facts where loc is not null""")
def pj22_serving(spark, sf):
    """PJ15: rounded probabilities, tier and the smell breakdown."""
    p = F.least(F.lit(1.0), F.col("loc") / 1000.0)
    f = facts(spark, sf, "row_id", "loc", "cc_mean", "maintainability_index", "smell_long_method", "smell_god_function").where("loc is not null")
    breakdown = F.struct(F.coalesce("smell_long_method", F.lit(0)).alias("long_method"), F.coalesce("smell_god_function", F.lit(0)).alias("god_function"))
    return f.select("row_id", F.round(p, 4).alias("bug_prob"), F.round(F.col("cc_mean").cast("double"), 2).alias("cc_mean"), F.round(F.col("maintainability_index").cast("double"), 1).alias("mi"), scalars.risk_tier(p).alias("risk_tier"), breakdown.alias("b")).select("row_id", "bug_prob", "cc_mean", "mi", "risk_tier", (F.col("b.long_method") + F.col("b.god_function")).alias("smell_sum"))


@book("pj23_labels", """select file_id, case when n < 1024 then format('{:.1f} B', n::double) else format('{:.1f} KB', n / 1024.0::double) end size, case when length(file_path) <= 20 then file_path when len(p) <= 2 then concat('...', right(file_path, 17))
 when length(t) + 4 <= 20 then concat('.../', t) else concat('...', right(t, 17)) end short from (select file_id, file_path, coalesce(length(content), 0) n, string_split(file_path, '/') p, array_to_string(string_split(file_path, '/')[-2:], '/') t from source_files where file_path is not null)""")
def pj23_labels(spark, sf):
    """Sizes and paths as a page shows them."""
    f = table(spark, sf, "source_files", "file_id", "file_path", "content").where("file_path is not null")
    return f.select("file_id", scalars.size_label(F.coalesce(F.length("content"), F.lit(0))).alias("size"), scalars.short_path(F.col("file_path"), 20).alias("short"))


@book("pj27_truthy", "select v, lower(trim(coalesce(v, ''))) in ('1', 'true', 'on', 'yes', 'evet') flag from (values ('1'), ('True'), (' evet '), ('no'), (''), (null)) t(v)")
def pj27_truthy(spark, sf):
    return spark.createDataFrame([("1",), ("True",), (" evet ",), ("no",), ("",), (None,)], "v string").select("v", scalars.truthy(F.col("v")).alias("flag"))


@book("pj28_class_weight", "with n as (select count(*) n, sum(bug_keyword) p from file_facts where bug_keyword is not null) select cast(p as bigint) n_pos, cast(n - p as bigint) n_neg, round(n / (2.0::double * (n - p)), 6) weight_0, round(n / (2.0::double * p), 6) weight_1, round((n - p) / greatest(p, 1)::double, 6) scale_pos_weight from n")
def pj28_class_weight(spark, sf):
    """AG33: label counts and class weights."""
    g = facts(spark, sf, "bug_keyword").where("bug_keyword is not null").agg(F.count("*").alias("n"), F.sum("bug_keyword").alias("n_pos")).withColumn("n_neg", F.col("n") - F.col("n_pos"))
    return g.select("n_pos", "n_neg", F.round(F.col("n") / (2.0 * F.col("n_neg")), 6).alias("weight_0"), F.round(F.col("n") / (2.0 * F.col("n_pos")), 6).alias("weight_1"), F.round(F.col("n_neg") / F.greatest("n_pos", F.lit(1)), 6).alias("scale_pos_weight"))


@book("pj29_percent", "select project_name, round(100.0::double * sum(cast(bug_count > 0 as int)) / greatest(count(*), 1), 1) pct from file_facts group by project_name")
def pj29_percent(spark, sf):
    return facts(spark, sf, "project_name", "bug_count").groupBy("project_name").agg(F.round(100.0 * F.sum((F.col("bug_count") > 0).cast("int")) / F.greatest(F.count("*"), F.lit(1)), 1).alias("pct"))


@book("fl1_commit_range", "select row_id from file_facts where commit_count between 10 and 80")
def fl1_commit_range(spark, sf):
    return dataset.commit_range(facts(spark, sf, "row_id", "commit_count"), 10, 80).select("row_id")


@book("fl2_enough_files", "select row_id from file_facts where project_name is not distinct from project_name qualify count(*) over (partition by project_name) >= 30")
def fl2_enough_files(spark, sf):
    """WN6: projects with at least 30 rows."""
    return dataset.enough_files(facts(spark, sf, "row_id", "project_name"), 30).select("row_id")


@book("fl10_sampled", "with p as (select project_name from (select distinct project_name from file_facts where project_name is not null) order by md5(concat(project_name, '|42')), project_name limit 50) select row_id from file_facts where project_name in (select project_name from p)")
def fl10_sampled(spark, sf):
    """Whole projects, a seeded choice of 50 (the sampling operator's own limit)."""
    return dataset.sampled_projects(facts(spark, sf, "row_id", "project_name"), 50).select("row_id")


@book("fl3_capped", "select row_id from file_facts qualify row_number() over (partition by project_name order by md5(concat(row_id::varchar, '|42')), row_id) <= 20")
def fl3_capped(spark, sf):
    """WN5: a seeded sample of at most 20 rows a project (the sampling operator's own limit)."""
    return dataset.capped(facts(spark, sf, "row_id", "project_name"), 20, "row_id").select("row_id")


@book("fl4_size_gate", "select file_id from source_files where length(content) <= 500000 and length(trim(content)) > 0")
def fl4_size_gate(spark, sf):
    return table(spark, sf, "source_files", "file_id", "content").where((F.length("content") <= 500_000) & (F.length(F.trim("content")) > 0)).select("file_id")


@book("fl6_unseen", "with f as (select full_name, contributor_count, row_number() over (partition by full_name order by found_at, discovery_id) rn from discovery where contributor_count <= 50) select full_name, contributor_count from f where rn = 1 and full_name not in (select full_name from category_labels where full_name is not null)")
def fl6_unseen(spark, sf):
    """DD2, JN14, ST3: few contributors, first sighting, not labelled yet."""
    d = table(spark, sf, "discovery", "discovery_id", "full_name", "contributor_count", "found_at").where("contributor_count <= 50")
    first = dataset.latest_per_key(d, ["full_name"], [F.asc("found_at"), F.asc("discovery_id")])
    return first.join(table(spark, sf, "category_labels", "full_name").distinct(), "full_name", "left_anti").select("full_name", "contributor_count")


@book("fl9_labelled", "select bug_szz, count(*) n from file_facts where bug_szz is not null and (select count(distinct bug_szz) from file_facts) >= 2 group by bug_szz")
def fl9_labelled(spark, sf):
    """Rows with a label, if the label has two classes."""
    f = facts(spark, sf, "bug_szz").na.drop().groupBy("bug_szz").agg(F.count("*").alias("n"))
    return f.withColumn("k", F.count("*").over(Window.partitionBy())).where("k >= 2").drop("k")


@book("fl12_search", "select file_id from source_files where contains(lower(file_path), 'parse')")
def fl12_search(spark, sf):
    return table(spark, sf, "source_files", "file_id", "file_path").where(F.contains(F.lower("file_path"), F.lit("parse"))).select("file_id")


_LATEST = "latest as (select * from file_facts qualify row_number() over (partition by project_name, file_path order by collected_at desc, row_id desc) = 1)"


@book("jn1_head_stats", f"with {_LATEST} select s.file_id, coalesce(l.commit_count, 0) commit_count, coalesce(l.bug_count, 0) bug_count from source_files s left join latest l on s.project_name = l.project_name and s.file_path = l.file_path")
def jn1_head_stats(spark, sf):
    """JN4, PJ18: files with their latest statistics, 0 where there are none."""
    f = facts(spark, sf, "row_id", "project_name", "file_path", "collected_at", "commit_count", "bug_count")
    latest = dataset.latest_per_key(f, ["project_name", "file_path"], [F.desc("collected_at"), F.desc("row_id")])
    s = table(spark, sf, "source_files", "file_id", "project_name", "file_path")
    return s.join(latest.select("project_name", "file_path", "commit_count", "bug_count"), ["project_name", "file_path"], "left").select("file_id", F.coalesce("commit_count", F.lit(0)).alias("commit_count"), F.coalesce("bug_count", F.lit(0)).alias("bug_count"))


@book("jn2_with_source", "select count(*) n from (select distinct project_name, file_path from file_facts) f join (select distinct project_name, file_path from source_files where content is not null) s using (project_name, file_path)")
def jn2_with_source(spark, sf):
    a = facts(spark, sf, "project_name", "file_path").distinct()
    b = table(spark, sf, "source_files", "project_name", "file_path", "content").where("content is not null").select("project_name", "file_path").distinct()
    return a.join(b, ["project_name", "file_path"]).agg(F.count("*").alias("n"))


@book("jn3_szz_fallback", "select row_id, coalesce(bug_szz, case when coalesce(bug_count, 0) > 0 then 1 else 0 end)::int bug_szz from file_facts")
def jn3_szz_fallback(spark, sf):
    return facts(spark, sf, "row_id", "bug_szz", "bug_count").select("row_id", F.coalesce(F.col("bug_szz").cast("int"), (F.coalesce("bug_count", F.lit(0)) > 0).cast("int")).alias("bug_szz"))


@book("jn5_project_dim", "with d as (select project_name, max(stars) stars_max, max(contributor_count) contributors from file_facts group by project_name) select f.row_id, stars_max, contributors from file_facts f join d on f.project_name is not distinct from d.project_name")
def jn5_project_dim(spark, sf):
    """Project values on every row: the dimension is aggregated first, then joined null-safely."""
    d = facts(spark, sf, "project_name", "stars", "contributor_count").groupBy(F.col("project_name").alias("p_")).agg(F.max("stars").alias("stars_max"), F.max("contributor_count").alias("contributors"))
    return facts(spark, sf, "row_id", "project_name").join(d, F.col("project_name").eqNullSafe(F.col("p_"))).select("row_id", "stars_max", "contributors")


@book("jn6_backfill", "with m as (select full_name, description d from discovery qualify row_number() over (partition by full_name order by found_at desc, discovery_id desc) = 1) select row_id, coalesce(nullif(description, ''), m.d, '') description from file_facts f left join m on f.project_name = m.full_name")
def jn6_backfill(spark, sf):
    """JN13, ST4, SK7: empty descriptions take the newest discovery's."""
    d = table(spark, sf, "discovery", "discovery_id", "full_name", "description", "found_at")
    meta = dataset.latest_per_key(d, ["full_name"], [F.desc("found_at"), F.desc("discovery_id")]).select(F.col("full_name").alias("project_name"), "description")
    return dataset.backfilled(facts(spark, sf, "row_id", "project_name", "description"), meta, "project_name", ["description"]).select("row_id", "description")


@book("jn7_signals", "with s as (select project_name, bool_or(has_dockerfile) has_dockerfile from file_facts where project_name is not null group by project_name) select file_id, coalesce(has_dockerfile, false) has_dockerfile from source_files f left join s on f.project_name = s.project_name")
def jn7_signals(spark, sf):
    s = facts(spark, sf, "project_name", "has_dockerfile").where("project_name is not null").groupBy("project_name").agg(F.bool_or("has_dockerfile").alias("has_dockerfile"))
    return table(spark, sf, "source_files", "file_id", "project_name").join(s, "project_name", "left").select("file_id", F.coalesce("has_dockerfile", F.lit(False)).alias("has_dockerfile"))


@book("jn8_category", f"with d as ({_CATS} qualify row_number() over (partition by full_name order by discovery_id) = 1) select row_id, coalesce(c[1], 'Diger') category from file_facts f left join d on f.project_name = d.full_name")
def jn8_category(spark, sf):
    """Categories of the distinct projects, joined to the rows."""
    d = dataset.latest_per_key(table(spark, sf, "discovery", "discovery_id", "full_name", "topics", "description"), ["full_name"], [F.asc("discovery_id")])
    cats = d.select(F.col("full_name").alias("project_name"), text.primary_category(text.categories(text.category_text(F.col("full_name"), F.col("topics"), F.col("description")))).alias("category"))
    return facts(spark, sf, "row_id", "project_name").join(cats, "project_name", "left").select("row_id", F.coalesce("category", F.lit("Diger")).alias("category"))


@book("jn12_grid_join", "with a as (select case when n_authors < 3 then n_authors end k, avg(bug_count) b from file_facts group by 1), s as (select case when n_authors < 3 then n_authors end k, avg(smell_count) s from file_facts group by 1) select a.k, round(b, 6) bug_metric, round(s, 6) smell_metric, round((b + s) / 2, 6) joint from a join s on a.k is not distinct from s.k")
def jn12_grid_join(spark, sf):
    """TK5: two grids joined null-safely."""
    k = F.when(F.col("n_authors") < 3, F.col("n_authors"))
    a = facts(spark, sf, "n_authors", "bug_count").groupBy(k.alias("k")).agg(F.avg("bug_count").alias("b"))
    s = facts(spark, sf, "n_authors", "smell_count").groupBy(k.alias("k2")).agg(F.avg("smell_count").alias("s"))
    return a.join(s, F.col("k").eqNullSafe(F.col("k2"))).select("k", F.round("b", 6).alias("bug_metric"), F.round("s", 6).alias("smell_metric"), F.round((F.col("b") + F.col("s")) / 2, 6).alias("joint"))


@book("tk5_joint_best", "with a as (select case when n_authors < 3 then n_authors end k, avg(bug_count) b from file_facts group by 1), s as (select case when n_authors < 3 then n_authors end k, avg(smell_count) s from file_facts group by 1) select a.k, round((b + s) / 2, 6) joint from a join s on a.k is not distinct from s.k order by joint desc nulls last, a.k nulls last limit 1")
def tk5_joint_best(spark, sf):
    """The cell of the joined grids with the best mean of both metrics."""
    return stats.top_k(jn12_grid_join(spark, sf).select("k", "joint"), [F.desc_nulls_last("joint"), F.asc_nulls_last("k")], 1)


@book("jn15_membership", "select row_id from file_facts where project_name in (select full_name from category_labels where category = 'Data')")
def jn15_membership(spark, sf):
    s = table(spark, sf, "category_labels", "full_name", "category").where("category = 'Data'").select(F.col("full_name").alias("project_name")).distinct()
    return facts(spark, sf, "row_id", "project_name").join(s, "project_name", "left_semi").select("row_id")


@book("jn16_append_family", "with r(model, f1) as (values ('rf', 0.5), ('lr', 0.4), ('hybrid', 0.6)), d(model, family) as (values ('rf', 'trees'), ('lr', 'linear')) select r.model, f1::double f1, coalesce(family, 'other') family from r left join d using (model)")
def jn16_append_family(spark, sf):
    r = spark.createDataFrame([("rf", 0.5), ("lr", 0.4)], "model string, f1 double").unionByName(spark.createDataFrame([("hybrid", 0.6)], "model string, f1 double"))
    return r.join(F.broadcast(spark.createDataFrame([("rf", "trees"), ("lr", "linear")], "model string, family string")), "model", "left").select("model", "f1", F.coalesce("family", F.lit("other")).alias("family"))


@book("st2_intersect", "select project_name, file_path from file_facts where project_name is not null intersect select project_name, file_path from source_files")
def st2_intersect(spark, sf):
    return facts(spark, sf, "project_name", "file_path").where("project_name is not null").intersect(table(spark, sf, "source_files", "project_name", "file_path"))


@book("st3_except", "select project_name from source_files where project_name is not null except select full_name from discovery")
def st3_except(spark, sf):
    return table(spark, sf, "source_files", "project_name").where("project_name is not null").distinct().join(table(spark, sf, "discovery", F.col("full_name").alias("project_name")).distinct(), "project_name", "left_anti")


@book("st4_upsert", "with o as (select project_name k, count(*) n from source_files where project_name is not null group by 1), w as (select project_name k, count(*) n from commit_log where project_name is not null group by 1) select coalesce(w.k, o.k) k, coalesce(w.n, o.n) n from o full join w on o.k = w.k")
def st4_upsert(spark, sf):
    """SK8: new values win over old ones."""
    n = lambda t: table(spark, sf, t, "project_name").where("project_name is not null").groupBy(F.col("project_name").alias("k")).agg(F.count("*").alias("n"))
    return dataset.upsert(n("source_files"), n("commit_log"), "k")


_SPLIT = "p as (select project_name, row_number() over (order by md5(concat(project_name, '|42')), project_name) r, count(*) over () n from (select distinct project_name from file_facts where project_name is not null)), s as (select project_name, case when r <= greatest(1, floor(n * 0.15::double)) then 'test' when r <= greatest(1, floor(n * 0.15::double)) * 2 then 'validation' else 'train' end part from p)"


@book("sp1_project_split", f"with {_SPLIT} select project_name, part from s")
def sp1_project_split(spark, sf):
    """SP2, SP6, WN8: whole projects into train, validation and test."""
    return splits.project_split(facts(spark, sf, "project_name"))


@book("sp2_rounded_split", "with p as (select project_name, row_number() over (order by md5(concat(project_name, '|42')), project_name) r, count(*) over () n from (select distinct project_name from file_facts where project_name is not null)) select project_name, case when r <= round_even(n * 0.15::double, 0) then 'test' when r <= 2 * round_even(n * 0.15::double, 0) then 'validation' else 'train' end part from p")
def sp2_rounded_split(spark, sf):
    """Whole projects, cut at shares rounded half to even."""
    return splits.project_split(facts(spark, sf, "project_name"), half_even=True)


@book("st5_split_overlap", f"with {_SPLIT} select count(*) projects, sum(cast(k > 1 as bigint))::bigint overlapping from (select project_name, count(distinct part) k from s group by 1)")
def st5_split_overlap(spark, sf):
    return splits.overlap(splits.project_split(facts(spark, sf, "project_name")))


@book("sp3_time_split", "with p as (select row_id, row_number() over (order by collected_at nulls last, row_id) r, count(*) over () n from file_facts) select row_id, case when r <= n - 2 * round_even(n * 0.15::double, 0) then 'train' when r <= n - round_even(n * 0.15::double, 0) then 'validation' else 'test' end part from p")
def sp3_time_split(spark, sf):
    """WN7: rows in time order, cut at half-even rounded shares."""
    f = facts(spark, sf, "row_id", "collected_at").withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    return splits.time_split(f, "collected_at", "row_id").select("row_id", "part")


@book("sp4_group_folds", """with recursive s as (select project_name, n, row_number() over (order by n desc, project_name) r from (select project_name, count(*) n from file_facts where project_name is not null group by 1)),
 g(r, project_name, fold, loads) as (select 0::bigint, null::varchar, 0::bigint, [0, 0, 0, 0, 0]::bigint[] union all
 select s.r, s.project_name, list_position(loads, list_min(loads))::bigint - 1, [case when i = list_position(loads, list_min(loads)) then x + s.n else x end for x, i in loads] from g join s on s.r = g.r + 1)
 select project_name, cast(fold as int) fold from g where r > 0""")
def sp4_group_folds(spark, sf):
    """Projects to the lightest fold, largest first."""
    return splits.group_folds(facts(spark, sf, "project_name"), 5)


@book("sp5_hash_folds", "select row_id, cast(('0x' || substr(md5(concat(row_id::varchar, '|42')), 1, 8))::bigint % 3 as int) fold from file_facts")
def sp5_hash_folds(spark, sf):
    """SP8: rows to folds by seeded hash."""
    return splits.hash_folds(facts(spark, sf, "row_id"), 3, "row_id").select("row_id", "fold")


@book("sp7_fold_number", "select n, least(5, n // 2) half, least(5, greatest(2, n // 2)) half_least_2, least(5, n) as groups_ from (select count(distinct project_name) n from file_facts)")
def sp7_fold_number(spark, sf):
    n = facts(spark, sf, "project_name").agg(F.count_distinct("project_name").alias("n"))
    half = F.floor(F.col("n") / 2)
    return n.select("n", F.least(F.lit(5), half).alias("half"), F.least(F.lit(5), F.greatest(F.lit(2), half)).alias("half_least_2"), F.least(F.lit(5), F.col("n")).alias("groups_"))
