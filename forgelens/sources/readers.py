"""Readers: project parquet sets, newest files, project JSON, CSV results, source text, listings, archives, search pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DISCOVERY = "found array<struct<full_name:string,clone_url:string,stars:int,created_at:string,project_age_days:int,contributor_count:int,default_branch:string,topics:array<string>,description:string>>"

# Limits of uploaded archives.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 50_000, 500 * 1024 * 1024, 100


def project_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, bytes, modified) of every parquet file below a directory, by name; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(directory).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("path")


def project_parquets(spark: SparkSession, directory: str) -> DataFrame:
    """All project files as one table; unreadable files are skipped, columns are united."""
    return spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(directory)


def latest_by_name(spark: SparkSession, directory: str, glob: str = "*.parquet") -> str | None:
    row = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select("path").agg(F.max("path").alias("p")).first()
    return row["p"]


def latest_by_time(spark: SparkSession, directory: str, glob: str, exclude: str = "LEAKY") -> str | None:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select("path", "modificationTime")
    return files.where(~F.contains("path", F.lit(exclude))).agg(F.max_by("path", "modificationTime").alias("p")).first()["p"]


def discovery_json(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """One row per project found; a malformed document gives no rows; missing fields take defaults. A document is a file, or a line."""
    rows = spark.read.schema(DISCOVERY).option("multiLine", str(not by_line).lower()).option("mode", "PERMISSIVE").json(path).select(F.explode("found").alias("p")).select("p.*")
    return rows.select("full_name", F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("created_at", F.lit("")).alias("created_at"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), F.coalesce("description", F.lit("")).alias("description"))


def results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def source_text(spark: SparkSession, directory: str, glob: str = "*.py") -> DataFrame:
    """(path, content) with undecodable bytes replaced."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(directory).select("path", F.decode("content", "UTF-8").alias("content"))


def archive_verdict(entries: DataFrame) -> DataFrame:
    """(archive, entries, bytes, ratio, verdict) from the entry table (archive, name, file_size, compress_size), before anything is unpacked."""
    bad = F.col("name").rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    g = entries.groupBy("archive").agg(F.count("*").alias("entries"), F.sum("file_size").alias("bytes"), F.sum("compress_size").alias("packed"), F.bool_or(bad).alias("escapes"))
    ratio = F.when(F.col("packed") > 0, F.col("bytes") / F.col("packed")).otherwise(0.0)
    verdict = F.when(F.col("entries") > MAX_ENTRIES, "too many entries").when(F.col("bytes") > MAX_BYTES, "too large").when(ratio > MAX_RATIO, "suspicious ratio").when(F.col("escapes"), "path outside").otherwise("ok")
    return g.select("archive", "entries", "bytes", F.round(ratio, 2).alias("ratio"), verdict.alias("verdict"))


def contributor_count(link: Column, listed: Column) -> Column:
    """The number of the last page of a paged answer, or the number listed, at least 1."""
    last = F.regexp_extract(F.coalesce(link, F.lit("")), r'[?&]page=(\d+)[^>]*>; rel="last"', 1)
    return F.when(last != "", last.cast("int")).otherwise(F.greatest(listed, F.lit(1)))


def linter_counts(outputs: DataFrame, key: str, output: str) -> DataFrame:
    """(key, source, n) of messages in linter output that starts with noise before its JSON.

    Output without readable JSON gives one row with null source and count; a readable one without messages gives none.
    """
    schema = "messages array<struct<source:string,message:string>>"
    body = F.from_json(F.expr(f"substring({output}, instr({output}, '{{'))"), schema)
    failed = F.array(F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("message")))
    read = outputs.select(key, body.alias("b_")).withColumn("failed_", F.col("b_").isNull() | ~F.coalesce(F.contains(F.to_json("b_"), F.lit("messages")), F.lit(False)))
    each = read.select(key, "failed_", F.explode(F.when(F.col("failed_"), failed).otherwise(F.col("b_.messages"))).alias("m"))
    return each.groupBy(key, F.when(~F.col("failed_"), F.coalesce("m.source", F.lit("unknown"))).alias("source")).agg(F.when(~F.bool_or("failed_"), F.count("*")).alias("n"))


def hashed_sample(paths: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """The first ``n`` paths in seeded hash order."""
    return paths.orderBy(F.md5(F.concat("path", F.lit("|" + seed))), "path").limit(n)


class _Page(InputPartition):
    def __init__(self, first: str, last: str) -> None:
        self.first, self.last = first, last


class SearchReader(DataSourceReader):
    """Reads search results by weekly windows, each window a partition, pages within it until one is short."""

    def __init__(self, fetch: Callable, windows: list[tuple[str, str]], page_size: int) -> None:
        self.fetch, self.windows, self.page_size = fetch, windows, page_size

    def partitions(self) -> list[InputPartition]:
        return [_Page(a, b) for a, b in self.windows]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = 1
        while True:
            rows = self.fetch(partition.first, partition.last, page)
            yield from rows
            if len(rows) < self.page_size:
                return
            page += 1


def search_source(name: str, fetch: Callable, windows: list[tuple[str, str]], page_size: int = 100) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; ``fetch(first, last, page)`` gives (full_name, stars) rows."""

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "full_name string, stars int"

        def reader(self, schema) -> DataSourceReader:
            return SearchReader(fetch, windows, page_size)

    return Search


def retry_wait(status: int, attempt: int, remaining: int | None = None, until_reset: int = 0) -> int | None:
    """Seconds to wait before the next try of a guarded request; None to give up, 0 to go on.

    A nearly used quota waits for its reset; refused and failing requests wait longer each time.
    """
    if remaining is not None and remaining < 10:
        return until_reset + 1
    ladder = {403: (5, 15, 45, 135), 429: (60, 60, 60)}
    steps = ladder.get(status, (2, 5, 10) if status >= 500 or status == 0 else None)
    if steps is None:
        return 0
    if status == 403 and until_reset:
        return until_reset + 1
    return steps[attempt] if attempt < len(steps) else None


__all__ = ["project_files", "project_parquets", "latest_by_name", "latest_by_time", "discovery_json", "results_csv", "source_text", "archive_verdict", "contributor_count", "linter_counts", "hashed_sample", "search_source", "retry_wait"]
