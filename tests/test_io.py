from __future__ import annotations

from forgelens.sources import readers, writers

from .conftest import rows


def test_archive_limits(spark):
    e = spark.createDataFrame([("ok", "a.py", 10, 5), ("up", "../x", 1, 1), ("abs", "/etc/x", 1, 1), ("win", "C:\\x", 1, 1), ("bomb", "z", 10_000, 1), ("huge", "h", 600 * 2 ** 20, 600 * 2 ** 20)], "archive string, name string, file_size long, compress_size long")
    assert {r.archive: r.verdict for r in readers.archive_verdict(e).collect()} == {"ok": "ok", "up": "path outside", "abs": "path outside", "win": "path outside", "bomb": "suspicious ratio", "huge": "too large"}


def test_dynamic_partitions_and_corrupt_files(spark, tmp_path):
    path = str(tmp_path / "p")
    writers.write_projects(spark.createDataFrame([("a", 1), ("b", 2)], "project_name string, x int"), path)
    writers.write_projects(spark.createDataFrame([("b", 3)], "project_name string, x int"), path)
    assert rows(spark.read.parquet(path), "project_name", "x") == [("a", 1), ("b", 3)]
    flat = tmp_path / "flat"
    spark.createDataFrame([(1,)], "x int").coalesce(1).write.parquet(str(flat))
    (flat / "part-bad.parquet").write_bytes(b"PAR1 not parquet PAR1")
    assert readers.project_parquets(spark, str(flat)).count() == 1


def test_status_log_and_empty_write(spark, tmp_path):
    path = str(tmp_path / "log")
    for s, t in (("failed", 1), ("ok", 2)):
        writers.append_status(spark.createDataFrame([("n", s, t)], "name string, status string, completed_at int"), path)
    assert rows(writers.current_status(spark, path), "name", "status") == [("n", "ok")]
    assert writers.write_dated(spark.range(0), str(tmp_path), "1") is None


def test_search_source(spark):
    pages = {("a", 1): [("x", 1), ("y", 2)], ("a", 2): [], ("b", 1): [("z", 3)]}
    spark.dataSource.register(readers.search_source("search_test", lambda f, l, p: pages.get((f, p), []), [("a", "a"), ("b", "b")], 2))
    assert rows(spark.read.format("search_test").load(), "full_name", "stars") == [("x", 1), ("y", 2), ("z", 3)]


def test_retry_ladder():
    assert readers.retry_wait(403, 0) == 5 and readers.retry_wait(403, 4) is None and readers.retry_wait(200, 0, remaining=3, until_reset=9) == 10 and readers.retry_wait(500, 1) == 5
