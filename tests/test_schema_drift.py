from __future__ import annotations

import json

from forgelens.operators import schema_drift as d

SCHEMA = "record_id long, stream_name string, batch_file string, batch_no int, payload string"


def snapshots(spark, files, stream="s"):
    """files: list of lists of records (dict) or raw text."""
    rows, n = [], 0
    for i, records in enumerate(files, 1):
        for r in records:
            n += 1
            rows.append((n, stream, f"{stream}/{i}", i, r if isinstance(r, str) or r is None else json.dumps(r)))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r.batch_file, r.field_name, r.change_kind) for r in d.changes(df).collect())


def names(n):
    return [f"o/p{i}" for i in range(n)]


def test_added_removed_typed_and_renamed(spark):
    one = [{"full_name": n, "stars": i * 7, "desc": f"text {i}"} for i, n in enumerate(names(8))]
    two = [{"full_name": n, "stars": str(i * 7), "summary": f"text {i}", "license": "x"} for i, n in enumerate(names(8))]
    three = [{"full_name": n, "star_count": str(i * 7), "summary": f"text {i}"} for i, n in enumerate(names(8))]
    assert found(snapshots(spark, [one, two, three])) == [
        ("s/2", "license", "added"), ("s/2", "stars", "type_changed"), ("s/2", "summary", "renamed"), ("s/3", "license", "removed"), ("s/3", "star_count", "renamed"),
    ]


def test_other_values_are_no_rename(spark):
    one = [{"full_name": n, "stars": i * 7} for i, n in enumerate(names(8))]
    two = [{"full_name": n, "watchers": i + 100} for i, n in enumerate(names(8))]
    assert found(snapshots(spark, [one, two])) == [("s/2", "stars", "removed"), ("s/2", "watchers", "added")]


def test_growing_counts_are_a_rename(spark):
    one = [{"full_name": n, "stars": 500 + i * 70} for i, n in enumerate(names(8))]
    two = [{"full_name": n, "star_count": 502 + i * 70} for i, n in enumerate(names(8))]
    assert found(snapshots(spark, [one, two])) == [("s/2", "star_count", "renamed")]


def test_strays_nulls_notation_and_unreadable(spark):
    one = [{"full_name": n, "stars": i, "created_at": "2020-01-02 03:04:05"} for i, n in enumerate(names(6))]
    two = [{"full_name": n, "stars": i if i else "many", "created_at": "02/01/2020 03:04"} for i, n in enumerate(names(6))] + ['{"full_name": "o/p1", "sta', None, "[1]"]
    two += [{"full_name": "o/p1", "stars": None}] + [{"full_name": n, "stars": 3} for n in names(2)]
    assert found(snapshots(spark, [one, two])) == []


def test_a_field_that_returns_and_streams_apart(spark):
    full, less = [{"full_name": "a/b", "x": 1}], [{"full_name": "a/b"}]
    df = snapshots(spark, [full, less, full]).union(snapshots(spark, [less, less], "t"))
    assert found(df) == [("s/2", "x", "removed"), ("s/3", "x", "added")]
    assert d.changes(df.limit(0)).count() == 0


def test_consistent_table(spark):
    df = snapshots(spark, [[{"full_name": "a/b", "star_count": "1,234", "tags": "x, y", "has_github_actions": "Y", "creation_date": "02/01/2020 03:04", "desc": {"text": "hi", "lang": "en"}, "odd": 1}, {"full_name": "c/d", "stars": 5.0, "topics": ["z"], "gh_actions": 0, "created_at": 1577934245}]])
    a, b = d.consistent(df).orderBy("full_name").collect()
    assert (a.stars, a.topics, a.has_github_actions, a.description, str(a.created_at), a.other) == (1234, ["x", "y"], True, "hi", "2020-01-02 03:04:00", '{"odd": 1}')
    assert (b.stars, b.topics, b.has_github_actions, str(b.created_at), b.other) == (5, ["z"], False, "2020-01-02 03:04:05", None)


def test_a_boolean_under_an_unknown_name_is_found_by_its_records(spark):
    flags = [i % 3 == 0 for i in range(60)]
    one = [{"full_name": n, "flagA": f, "k": 1} for n, f in zip(names(60), flags)]
    two = [{"full_name": n, "other": f, "k": 1} for n, f in zip(names(60), flags)]
    three = [{"full_name": n, "unlike": i % 5 == 0, "k": 1} for i, n in enumerate(names(60))]
    assert found(snapshots(spark, [one, two, three])) == [("s/2", "other", "renamed"), ("s/3", "other", "removed"), ("s/3", "unlike", "added")]


def test_aliases_are_a_parameter(spark):
    one = [{"full_name": n, "aa": True} for n in names(5)]
    two = [{"full_name": n, "bb": True} for n in names(5)]  # one value for all proves nothing
    df = snapshots(spark, [one, two])
    kinds = lambda al: sorted(r.change_kind for r in d.changes(df, al).collect())
    assert kinds({}) == ["added", "removed"] and kinds({"aa": ("boolean", ("bb",))}) == ["renamed"]


def test_types_are_voted_by_record(spark):
    one = [{"full_name": n, "x": 1} for n in names(5)]
    two = [{"y": i, "x": 7} for i in range(4)] + [{"full_name": "o/p1", "x": "a"}, {"full_name": "o/p2", "x": "b"}, {"full_name": "o/p3", "x": "c"}]
    assert ("s/2", "x", "type_changed") not in found(snapshots(spark, [one, two]))  # four integers against three strings
