"""Queries of sources, sinks and streams: written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgelens.plans.base import Book, facts
from forgelens.session import scratch, table
from forgelens.sources import readers, writers
from forgelens.streaming import streams

book = Book()


@book("sk1_project_partitions", "select project_name, count(*) n, sum(loc) loc from file_facts where project_name is not null group by project_name")
def sk1_project_partitions(spark, sf):
    """SC2: one partition per project, written and read again."""
    path = scratch(spark, "projects")
    writers.write_projects(facts(spark, sf, "project_name", "loc").where("project_name is not null").repartition("project_name"), path)
    return spark.read.parquet(path).select(F.col("project_name").cast("string").alias("project_name"), "loc").groupBy("project_name").agg(F.count("*").alias("n"), F.sum("loc").alias("loc"))


@book("sc2_project_files", "select count(*) n, sum(loc) loc, count(distinct file_path) paths from file_facts where project_name is not null")
def sc2_project_files(spark, sf):
    """The files of all projects as one table, a broken one among them skipped."""
    path = scratch(spark, "project-files")
    writers.write_projects(facts(spark, sf, "project_name", "file_path", "loc").where("project_name is not null").repartition("project_name"), path)
    spark.createDataFrame([("no parquet",)], "value string").write.text(f"{path}/project_name=broken")
    return readers.project_parquets(spark, path).agg(F.count("*").alias("n"), F.sum("loc").alias("loc"), F.count_distinct("file_path").alias("paths"))


@book("sk2_dated", "select count(*) n from file_facts")
def sk2_dated(spark, sf):
    """SK3, SC4: dated data sets, of which the newest is read by partition."""
    directory = scratch(spark, "dated")
    writers.write_dated(facts(spark, sf, "row_id").limit(0), directory, "20250101")
    writers.write_dated(table(spark, sf, "discovery", F.col("discovery_id").alias("row_id")), directory, "20250201")
    writers.write_dated(facts(spark, sf, "row_id"), directory, "20250301")
    d = spark.read.parquet(directory)
    newest = d.agg(F.max("ts")).first()[0]
    return d.where(F.col("ts") == newest).agg(F.count("*").alias("n"))


@book("sc1_listing", "select 1::bigint files, true positive")
def sc1_listing(spark, sf):
    """SC5: files of a directory with size and time, contents unread."""
    directory = scratch(spark, "listing")
    facts(spark, sf, "row_id").coalesce(1).write.parquet(directory)
    return readers.project_files(spark, directory).agg(F.count("*").alias("files"), (F.min("bytes") > 0).alias("positive"))


@book("sc5_latest_by_time", "select true found")
def sc5_latest_by_time(spark, sf):
    directory = scratch(spark, "latest")
    facts(spark, sf, "row_id").coalesce(1).write.parquet(directory)
    found = readers.latest_by_time(spark, directory, "*.parquet")
    return spark.createDataFrame([(found is not None and found == readers.latest_by_name(spark, directory),)], "found boolean")


@book("sk4_csv", "select project_name, count(*) n from file_facts where project_name is not null group by project_name")
def sk4_csv(spark, sf):
    """SC7: a report as CSV."""
    path = scratch(spark, "report.csv")
    writers.write_csv(facts(spark, sf, "project_name").where("project_name is not null").groupBy("project_name").agg(F.count("*").alias("n")), path)
    return readers.results_csv(spark, path, "project_name string, n bigint")


@book("sk5_json", "select full_name, coalesce(stars, 0) stars, coalesce(description, '') description from discovery")
def sk5_json(spark, sf):
    """SC6: the project dimension as one JSON document, and back with defaults."""
    path = scratch(spark, "discovery.json")
    d = table(spark, sf, "discovery", "full_name", "clone_url", "stars", "created_at", "project_age_days", "contributor_count", "default_branch", "topics", "description")
    d.select(F.to_json(F.struct(F.array(F.struct("*")).alias("found")), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    spark.createDataFrame([('{"found": [{"full_name": "cut/off", ',), ("no JSON",)], "value string").write.mode("append").text(path)  # gives no rows
    return readers.discovery_json(spark, path, by_line=True).select("full_name", "stars", "description")


@book("sk7_status_log", "select event_type name, max(event_id) last from events group by event_type")
def sk7_status_log(spark, sf):
    """SK6: an append log of which the last status per name holds."""
    path = scratch(spark, "status")
    e = table(spark, sf, "events", F.col("event_type").alias("name"), F.lit("ok").alias("status"), F.col("event_id").alias("completed_at"))
    writers.append_status(e.where("completed_at % 2 = 0"), path)
    writers.append_status(e.where("completed_at % 2 = 1"), path)
    return writers.current_status(spark, path).select("name", F.col("completed_at").alias("last"))


@book("sk8_merged", "with o as (select project_name k, count(*) v from source_files where project_name is not null group by 1), n as (select project_name k, count(*) v from commit_log where project_name is not null group by 1) select coalesce(n.k, o.k) k, coalesce(n.v, o.v) v from o full join n on o.k = n.k")
def sk8_merged(spark, sf):
    n = lambda t: table(spark, sf, t, "project_name").where("project_name is not null").groupBy(F.col("project_name").alias("k")).agg(F.count("*").alias("v"))
    return writers.merged_results(n("source_files"), n("commit_log"), "k", "v")


@book("sc13_search", "select full_name, stars from (values ('a/0', 0), ('a/1', 1), ('a/2', 2), ('b/0', 0)) t(full_name, stars)")
def sc13_search(spark, sf):
    """SC14: a paged search as a data source, here over a stand-in service."""
    pages = {("2025-01-01", 1): [("a/0", 0), ("a/1", 1)], ("2025-01-01", 2): [("a/2", 2)], ("2025-01-08", 1): [("b/0", 0)]}
    source = readers.search_source("forgelens_search", lambda first, last, page: pages.get((first, page), []), [("2025-01-01", "2025-01-07"), ("2025-01-08", "2025-01-14")], 2)
    spark.dataSource.register(source)
    return spark.read.format("forgelens_search").load()


@book("sc15_retries", "select status, attempt, wait from (values (200, 0, 0), (403, 0, 5), (403, 3, 135), (403, 4, null), (429, 1, 60), (500, 2, 10), (503, 3, null), (404, 0, 0)) t(status, attempt, wait)")
def sc15_retries(spark, sf):
    cases = [(200, 0), (403, 0), (403, 3), (403, 4), (429, 1), (500, 2), (503, 3), (404, 0)]
    return spark.createDataFrame([(s, a, readers.retry_wait(s, a)) for s, a in cases], "status int, attempt int, wait int")


@book("sc16_contributors", "select discovery_id, greatest(coalesce(contributor_count, 1), 1) n from discovery")
def sc16_contributors(spark, sf):
    """Contributor counts from the link of the last page, or the listed number."""
    d = table(spark, sf, "discovery", "discovery_id", "contributor_count")
    link = F.when(F.col("contributor_count") > 1, F.format_string('<https://git.example.org/x?per_page=1&page=%d>; rel="last"', F.col("contributor_count")))
    return d.select("discovery_id", readers.contributor_count(link, F.coalesce("contributor_count", F.lit(1))).alias("n"))


@book("sc17_lookup", "select full_name, max(stars) stars from discovery where full_name = (select min(full_name) from discovery) group by full_name")
def sc17_lookup(spark, sf):
    d = table(spark, sf, "discovery", "full_name", "stars")
    return d.join(F.broadcast(d.agg(F.min("full_name").alias("full_name"))), "full_name", "left_semi").groupBy("full_name").agg(F.max("stars").alias("stars"))


@book("sc19_archives", "select o_custkey archive, count(*) entries, cast(sum(floor(l_extendedprice)) as bigint) bytes, round(sum(floor(l_extendedprice)) / sum(l_quantity), 2) ratio, case when sum(floor(l_extendedprice)) / sum(l_quantity) > 100 then 'suspicious ratio' else 'ok' end verdict from lineitem join orders on l_orderkey = o_orderkey group by o_custkey")
def sc19_archives(spark, sf):
    """Archives judged from their entry tables."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity").join(table(spark, sf, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    entries = li.select(F.col("o_custkey").alias("archive"), F.concat(F.lit("src/f"), F.col("l_partkey").cast("string")).alias("name"), F.floor("l_extendedprice").alias("file_size"), F.col("l_quantity").cast("bigint").alias("compress_size"))
    return readers.archive_verdict(entries)


@book("sc21_linter_output", "select event_id, event_type source, 1::bigint n from events")
def sc21_linter_output(spark, sf):
    """Messages by source from output with noise before its JSON."""
    e = table(spark, sf, "events", "event_id", "event_type")
    body = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("source"), F.lit("m").alias("message"))).alias("messages")))
    return readers.linter_counts(e.select("event_id", F.concat(F.lit("warming up\n"), body).alias("output")), "event_id", "output")


@book("sc22_hashed_sample", "select path from (select distinct file_path path from source_files where file_path is not null) order by md5(concat(path, '|42')), path limit 20")
def sc22_hashed_sample(spark, sf):
    """A seeded sample of paths (its size is the operator's purpose)."""
    return readers.hashed_sample(table(spark, sf, "source_files", F.col("file_path").alias("path")).where("path is not null").distinct(), 20)


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, df, name):
    out = scratch(spark, name)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


_CLOSED = "(select date_trunc('milliseconds', max(ts)) - interval 1 day from events)"


@book("stream_windows", f"""with w as (select date_trunc('day', ts)::timestamp - to_days(k::int) as "start", event_type from events, range(7) r(k)) select "start", event_type, count(*) n from w where "start" + interval 7 day <= {_CLOSED} group by all""")
def stream_windows(spark, sf):
    """Sliding windows of a stream that its watermark has closed (an extension)."""
    return _run(spark, streams.windowed_counts(_stream(spark, sf)), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@book("stream_bursts", f"""with o as (select user_id, ts, cast(coalesce(ts >= lag(ts) over w + interval 30 minute, true) as int) fresh from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) g from o)
 select min(ts) as "start", user_id, count(*) n from s group by user_id, g having max(ts) + interval 30 minute <= {_CLOSED}""")
def stream_bursts(spark, sf):
    """Sessions of users that the watermark has closed (an extension)."""
    return _run(spark, streams.bursts(_stream(spark, sf)), "bursts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@book("stream_distinct", "select count(distinct event_id) n from events")
def stream_distinct(spark, sf):
    """Events once each (an extension)."""
    return _run(spark, streams.without_repeats(_stream(spark, sf), "event_id").select("event_id"), "distinct").agg(F.count("*").alias("n"))
