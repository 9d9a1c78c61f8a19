"""Versioned tables: what a change writes, what older versions keep, odd keys."""

import pytest

from terrafold.sources import versions

SCHEMA = "k long, g string, v long"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def files_of(path):
    return {p: p.stat().st_mtime_ns for p in path.glob("data/*/*/*.parquet")}


def test_an_upsert_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    table = tmp_path / "t"
    first = [(k, "g", k) for k in range(2000)]
    assert versions.create(spark.createDataFrame(first, SCHEMA), str(table), ["k"], 200) == 1
    before = files_of(table)
    assert len(before) == 200
    old = versions.read(spark, str(table), SCHEMA, 1)
    assert versions.upsert(spark.createDataFrame([(5, "new", -5), (9999, "new", 1)], SCHEMA), str(table)) == 2
    after = files_of(table)
    # two keys of 2,000 are two buckets of 200 at most, and nothing that was there is touched
    assert before.items() <= after.items() and 1 <= len(after) - len(before) <= 2
    assert rows_of(old) == rows_of(spark.createDataFrame(first, SCHEMA))
    assert rows_of(versions.read(spark, str(table), SCHEMA)) == sorted([r for r in first if r[0] != 5] + [(5, "new", -5), (9999, "new", 1)], key=repr)
    assert versions.delete(spark.createDataFrame([(k,) for k in range(1990)], "k long"), str(table), SCHEMA) == 3
    assert {r.k for r in versions.read(spark, str(table), SCHEMA).collect()} == {*range(1990, 2000), 9999}
    assert versions.versions(spark, str(table)) == [1, 2, 3] and versions.read(spark, str(table), SCHEMA, 2).count() == 2001


def test_null_keys_repeated_rows_and_empty_changes(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k", "g"]
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    versions.create(frame((None, None, 1), (1, None, 1), (1, "a", 1), (1, "a", 7)), path, keys, 8)
    assert rows_of(versions.read(spark, path, SCHEMA)) == rows_of(frame((None, None, 1), (1, None, 1), (1, "a", 7)))
    versions.upsert(frame((None, None, 2), (None, "a", 3), (1, "a", None)), path)
    assert rows_of(versions.read(spark, path, SCHEMA)) == rows_of(frame((None, None, 2), (None, "a", 3), (1, None, 1), (1, "a", None)))
    versions.upsert(frame(), path)
    versions.delete(versions.read(spark, path, SCHEMA).select(*keys), path, SCHEMA)
    assert versions.read(spark, path, SCHEMA).count() == 0 and versions.read(spark, path, SCHEMA, 1).count() == 3
    versions.upsert(frame((4, "b", 4)), path)
    assert rows_of(versions.read(spark, path, SCHEMA)) == [(4, "b", 4)]


def test_races_and_missing_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.createDataFrame([], SCHEMA), path, ["k"])
    assert versions.read(spark, path, SCHEMA).count() == 0
    with pytest.raises(ValueError):
        versions.create(spark.createDataFrame([], SCHEMA), path, ["k"])
    with pytest.raises(ValueError):
        versions.read(spark, path, SCHEMA, 7)
    with pytest.raises(RuntimeError):
        versions._publish(spark, path, 1, [(["k"], 8, None, None)])
