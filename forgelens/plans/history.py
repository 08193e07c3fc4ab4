"""Queries over commit history and message classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgelens.functions import text
from forgelens.operators import history, labels
from forgelens.plans.base import AS_OF, COMMITS_SQL, TOUCHES_AS_OF, TOUCHES_SQL, Book, commits, touches
from forgelens.session import table

book = Book()


def _matches(pattern: str) -> str:
    return "regexp_matches(subject, '" + pattern.replace("'", "''") + "')"


BUG_SQL, REFACTOR_SQL = _matches(text.BUG_PATTERN), _matches(text.REFACTOR_PATTERN)
REVERT_SQL = _matches(text.REVERT_PATTERN).replace("(subject", "(trim(subject)")
GROUP_SQL = {g: f"cast({_matches(text.group_pattern(g))} as int)" for g in text.BUG_GROUPS}


@book("ag1_file_stats", f"""with {TOUCHES_SQL}
select project, path, count(*) commit_count, sum(cast({BUG_SQL} as bigint)) bug_count, {', '.join(f"sum({GROUP_SQL[g]}) bug_kw_{g}_count" for g in text.BUG_GROUPS)},
 count(distinct author) n_authors, round(greatest(({TOUCHES_AS_OF} - min(ts)) / 86400.0::double, 0.5::double), 1) file_age_days,
 coalesce(sum(added + deleted), 0)::double churn_total, round(coalesce(avg(added + deleted), 0), 1) avg_churn_per_commit, coalesce(max(added + deleted), 0)::double max_single_churn,
 sum(cast(ts >= {TOUCHES_AS_OF} - 7776000 as bigint)) recent_commits_90d from touches group by project, path""")
def ag1_file_stats(spark, sf):
    """Process metrics per file from one aggregate over its touches."""
    return history.file_stats(touches(spark, sf), TOUCHES_AS_OF)


_GINI = """counts as (select repo, author, count(*) n from commits where author is not null group by repo, author),
 ranked as (select repo, n, row_number() over (partition by repo order by n, author) i, count(*) over (partition by repo) m, sum(n) over (partition by repo) t from counts),
 g as (select repo, round(2.0::double * sum(i * n) / (max(m) * max(t)) - (max(m) + 1)::double / max(m), 4) contribution_gini from ranked group by repo),
 e as (select repo, round(coalesce(sum(-(n / t::double) * log2(n / t::double)), 0) + 0.0, 4) author_entropy from ranked group by repo),
 gaps as (select repo, ts - lag(ts) over (partition by repo order by ts) gap from commits where ts is not null),
 c as (select repo, round(case when count(gap) >= 1 and avg(gap) > 0 then stddev_pop(gap::double) / avg(gap::double) else 0 end, 4) inter_commit_time_cv from gaps group by repo)"""


@book("ag2_repo_summary", f"""with {COMMITS_SQL}, {_GINI},
 b as (select repo, count(*) total_commits, sum(cast({BUG_SQL} as bigint)) bug_commits, sum(cast({REFACTOR_SQL} as bigint)) refactor_commits,
 sum(cast({REVERT_SQL} as bigint)) revert_count, sum(cast(coalesce(ts >= {AS_OF} - 7776000, false) as bigint)) recent_commits from commits group by repo)
 select b.*, round(refactor_commits / total_commits::double, 4) refactor_ratio, coalesce(contribution_gini, 0) contribution_gini, coalesce(inter_commit_time_cv, 0) inter_commit_time_cv, coalesce(author_entropy, 0) author_entropy
 from b left join g on b.repo is not distinct from g.repo left join c on b.repo is not distinct from c.repo left join e on b.repo is not distinct from e.repo""")
def ag2_repo_summary(spark, sf):
    """Counts, ratio, Gini, cadence and entropy per repository."""
    return history.repo_summary(commits(spark, sf), AS_OF)


@book("ag3_gini", f"with {COMMITS_SQL}, {_GINI} select repo, contribution_gini from g")
def ag3_gini(spark, sf):
    return history.gini(history.author_counts(commits(spark, sf)))


@book("ag4_cadence", f"with {COMMITS_SQL}, {_GINI} select repo, inter_commit_time_cv from c")
def ag4_cadence(spark, sf):
    return history.cadence(commits(spark, sf))


@book("ag5_entropy", f"with {COMMITS_SQL}, {_GINI} select repo, author_entropy from e")
def ag5_entropy(spark, sf):
    return history.entropy(history.author_counts(commits(spark, sf)))


@book("pj1_bug_message", f"with {COMMITS_SQL} select commit_row_id, {BUG_SQL} is_bug, {REFACTOR_SQL} is_refactor, {REVERT_SQL} is_revert from commits")
def pj1_bug_message(spark, sf):
    """PJ1, PJ3, PJ4: bug, refactoring and revert messages."""
    s = F.col("subject")
    return commits(spark, sf).select("commit_row_id", text.is_bug_message(s).alias("is_bug"), text.is_refactor_message(s).alias("is_refactor"), text.is_revert(s).alias("is_revert"))


@book("pj2_bug_groups", f"with {COMMITS_SQL} select commit_row_id, {', '.join(f'{GROUP_SQL[g]} bug_kw_{g}' for g in text.BUG_GROUPS)} from commits")
def pj2_bug_groups(spark, sf):
    return commits(spark, sf).select("commit_row_id", *[c.alias(f"bug_kw_{g}") for g, c in text.bug_groups(F.col("subject")).items()])


_LINES = "lines as (select project_name, concat(coalesce(ts, ''), '|', coalesce(author, ''), '|', coalesce(subject, '')) line from commit_log), p as (select project_name, regexp_extract(line, '^([^|]*)[|]([^|]*)[|]((?s:.*))$', ['ts', 'author', 'subject']) x from lines)"


@book("sc8_log_lines", f"with {_LINES} select project_name, count(*) n, count(try_cast(case when regexp_full_match(trim(x.ts), '[+-]?[0-9]+') then trim(x.ts) end as bigint)) readable, count(distinct x.author) authors, sum(cast(contains(x.subject, '|') as bigint)) with_bar from p group by project_name")
def sc8_log_lines(spark, sf):
    """Commit-log lines split at the first two bars; the subject keeps the rest. Every row is a line, missing parts are empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    lines = table(spark, sf, "commit_log", "project_name", "ts", "author", "subject").select("project_name", F.concat_ws("|", part("ts"), part("author"), part("subject")).alias("line"))
    return history.split_log_lines(lines, "line", "project_name").groupBy("project_name").agg(
        F.count("*").alias("n"), F.count(F.expr("try_cast(trim(ts) as bigint)")).alias("readable"), F.count_distinct("author").alias("authors"), F.sum(F.contains("subject", F.lit("|")).cast("long")).alias("with_bar"))


@book("sc9_numstat", f"with {TOUCHES_SQL} select project, count(*) touches, count(added + deleted) with_churn, sum(added + deleted) churn from touches group by project")
def sc9_numstat(spark, sf):
    """Numstat text parsed; binary touches count as touches but not as churn."""
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    text_lines = touches(spark, sf).select("project", F.concat_ws("\t", count("added"), count("deleted"), F.col("path").cast("string")).alias("line"))
    churn = F.col("added") + F.col("deleted")
    return history.parsed_numstat(text_lines, "line", "project").groupBy("project").agg(F.count("*").alias("touches"), F.count(churn).alias("with_churn"), F.sum(churn).alias("churn"))


@book("sc11_bug_fix_hashes", f"with {COMMITS_SQL} select distinct sha from commits where {BUG_SQL}")
def sc11_bug_fix_hashes(spark, sf):
    return history.bug_fix_hashes(commits(spark, sf))


@book("sc20_local_meta", f"with {COMMITS_SQL} select repo, count(distinct trim(author)) contributor_count, min(ts) first_ts, greatest(cast(floor(({AS_OF} - min(ts)) / 86400.0) as bigint), 1) project_age_days from commits group by repo")
def sc20_local_meta(spark, sf):
    """Distinct authors, first commit and age of every repository from its log."""
    return commits(spark, sf).groupBy("repo").agg(F.count_distinct(F.trim("author")).alias("contributor_count"), F.min("ts").alias("first_ts")).withColumn("project_age_days", F.greatest(F.floor((F.lit(AS_OF) - F.col("first_ts")) / 86400.0), F.lit(1)))


_SERIES = "series as (select user_id file, row_number() over (partition by user_id order by ts, event_id) - 1 idx, cast(event_type = 'error' as int) is_intro from events)"


def _series(spark, sf):
    from pyspark.sql.window import Window

    e = table(spark, sf, "events", "user_id", "ts", "event_id", "event_type")
    return e.select(F.col("user_id").alias("file"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("idx"), (F.col("event_type") == "error").cast("int").alias("is_intro"))


@book("ag14_bug_series", f"""with {_SERIES}, b as (select * from series where is_intro = 1), f as (select file, min(idx) first from b group by file), g as (select idx - lag(idx) over (partition by file order by idx) gap from b)
 select (select count(*) from f) files_with_bug, (select round(coalesce(avg(first), 0), 2) from f) mean_to_first, (select round(coalesce(median(first), 0), 2) from f) median_to_first, (select round(coalesce(avg(gap), 0), 2) from g) mean_between""")
def ag14_bug_series(spark, sf):
    """WN2, TK7: commits to the first bug and between bugs."""
    return history.bug_series_stats(_series(spark, sf))


@book("wn3_gaps", f"with {COMMITS_SQL}, g as (select repo, ts - lag(ts) over (partition by repo order by ts) gap from commits where ts is not null) select repo, count(gap) gaps, min(gap) least, max(gap) most, count(*) filter (where gap = 0) zero from g group by repo")
def wn3_gaps(spark, sf):
    """Gaps between commits in a row, those of the same second included."""
    return history.gaps(commits(spark, sf)).groupBy("repo").agg(F.count("gap").alias("gaps"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.count_if(F.col("gap") == 0).alias("zero"))


@book("wn12_trailing", "with c as (select user_id repo, cast(floor(epoch(ts)) as bigint) ts, event_id from events) select event_id, count(*) over (partition by repo order by ts range between 7776000 preceding and current row) n_trailing from c")
def wn12_trailing(spark, sf):
    """Commits in the 90 days up to each commit."""
    c = table(spark, sf, "events", "user_id", "ts", "event_id").select(F.col("user_id").alias("repo"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    return history.trailing_count(c).select("event_id", F.col("trailing").alias("n_trailing"))


@book("lb4_touched", f"with {TOUCHES_SQL}, fixes as (select distinct sha from touches where {BUG_SQL}), head as (select p_partkey path from part where p_size <= 25) select distinct path, 1 bug_szz from touches where sha in (select sha from fixes) and path in (select path from head)")
def lb4_touched(spark, sf):
    """JN9, JN10, ST2: files at HEAD that bug-fix commits touched."""
    t = touches(spark, sf)
    head = table(spark, sf, "part", "p_partkey", "p_size").where("p_size <= 25").select(F.col("p_partkey").alias("path"))
    return history.touched_by(t.select("sha", "path"), history.bug_fix_hashes(t), head)


_LINE_TOUCHES = "lt as (select l_partkey path, l_linenumber line, o_orderdate ts, o_orderpriority like '1%' or o_orderpriority like '5%' is_fix from lineitem join orders on l_orderkey = o_orderkey)"


@book("lb4_szz", f"""with {_LINE_TOUCHES}, per_line as (select path, line, min(ts) first, max(case when is_fix then ts end) fixed from lt group by 1, 2), head as (select distinct p_partkey path from part where p_size <= 25)
 select head.path, cast(head.path in (select path from per_line where fixed > first) as int) bug_szz from head""")
def lb4_szz(spark, sf):
    """JN10: files at HEAD of which a fix touched a line that an earlier commit had written (line = order line number)."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    fix = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("5")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), fix.alias("is_fix"))
    return history.line_labels(lines, table(spark, sf, "part", "p_partkey", "p_size").where("p_size <= 25").select(F.col("p_partkey").alias("path")))


@book("lb1_bug_keyword", "select cast(case when coalesce(bug_count, 0) > 0 then 1 else 0 end as tinyint) bug_keyword_new, count(*) n from file_facts group by 1")
def lb1_bug_keyword(spark, sf):
    return table(spark, sf, "file_facts", "bug_count").groupBy(labels.bug_keyword(F.col("bug_count")).alias("bug_keyword_new")).agg(F.count("*").alias("n"))
