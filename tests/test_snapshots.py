"""Snapshots: what a failed, repeated or overtaken write leaves to readers."""

import pytest
from pyspark.sql import functions as F

from gistmill.sources import snapshots


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "rel_path string, body string")


def read(spark, path, version=None):
    return sorted(tuple(r) for r in snapshots.read_snapshot(spark, path, version).collect())


def test_parts_are_replaced_and_versions_stay(spark, tmp_path):
    path = str(tmp_path / "笔记 1")
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, path)
    assert snapshots.write_snapshot(rows(spark, ("a", "1"), ("b", None)), path, "2026-07-20") == 1
    assert snapshots.write_snapshot(rows(spark, ("c", "2")), path, "2026-07-21") == 2
    assert snapshots.write_snapshot(rows(spark, ("a", "3")), path, "2026-07-20") == 3
    assert read(spark, path) == [("a", "3"), ("c", "2")]
    assert read(spark, path, 1) == [("a", "1"), ("b", None)]
    snapshots.write_snapshot(rows(spark), path, "2026-07-21")
    assert read(spark, path) == [("a", "3")] and snapshots.versions(spark, path) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, path, 9)
    with pytest.raises(ValueError):
        snapshots.write_snapshot(rows(spark).drop("body"), path, "x")


def test_a_write_that_dies_leaves_the_former_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    snapshots.write_snapshot(rows(spark, ("a", "1")), path, "d")
    dying = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("rel_path"), F.when(F.col("id") < 900, "x").otherwise(F.raise_error(F.lit("lost"))).cast("string").alias("body"))
    with pytest.raises(Exception, match="lost"):
        snapshots.write_snapshot(dying, path, "d")
    assert read(spark, path) == [("a", "1")]

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        snapshots.write_snapshot(rows(spark, ("a", "2")), path, "d")
    monkeypatch.undo()
    assert read(spark, path) == [("a", "1")]
    assert snapshots.write_snapshot(rows(spark, ("a", "2")), path, "d") == 2 and read(spark, path) == [("a", "2")]


def test_a_writer_that_is_overtaken_keeps_both(spark, tmp_path, monkeypatch):
    path, plain, tries = str(tmp_path / "kb"), snapshots._publish, []

    def overtaken(session, where, version, manifest):
        tries.append(version)
        if len(tries) == 1:
            snapshots.write_snapshot(rows(spark, ("b", "2")), path, "other")
        return plain(session, where, version, manifest)

    monkeypatch.setattr(snapshots, "_publish", overtaken)
    assert snapshots.write_snapshot(rows(spark, ("a", "1")), path, "one") == 2
    assert tries == [1, 1, 2] and read(spark, path) == [("a", "1"), ("b", "2")]
