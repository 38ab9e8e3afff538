"""Streams over folders that grow, stop and start anew."""

import pytest

from gistmill.streaming import items as stream

SCHEMA = "seq long, media_id string, folder_id string"


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def passed(spark, path):
    return sorted((r.media_id, r.seq) for r in spark.read.parquet(f"{path}/items").collect())


@pytest.fixture
def landed(spark, tmp_path):
    folder = tmp_path / "landed"
    land(spark, folder, "a", [(1, "x", None), (2, "y", None), (3, "x", None), (4, "z", "f"), (5, None, None)])
    return folder


def read(spark, folder):
    return stream.read_items(spark, f"{folder}/*.parquet", SCHEMA, files_per_trigger=1)


def test_syncs_pass_each_item_once(spark, tmp_path, landed):
    path = str(tmp_path / "out")
    before = stream.last_sync(spark, path).first()
    assert tuple(before) == (None, 0, 0)
    stream.sync_items(read(spark, landed), path, str(tmp_path / "log-1")).awaitTermination()
    assert passed(spark, path) == [("x", 1), ("y", 2)]
    first = stream.last_sync(spark, path).first()
    # The same sync goes on; then a new one starts from what passed.
    land(spark, landed, "b", [(6, "y", None), (7, "w", None)])
    stream.sync_items(read(spark, landed), path, str(tmp_path / "log-1")).awaitTermination()
    assert passed(spark, path) == [("w", 7), ("x", 1), ("y", 2)]
    land(spark, landed, "c", [(8, "x", None), (9, "v", None), (10, "v", None)])
    stream.sync_items(read(spark, landed), path, str(tmp_path / "log-2")).awaitTermination()
    assert passed(spark, path) == [("v", 9), ("w", 7), ("x", 1), ("y", 2)]
    last = stream.last_sync(spark, path).first()
    assert last["items"] == 4 and last.last_sync > first.last_sync


def test_ids_of_a_seen_table_never_pass(spark, tmp_path, landed):
    seen = spark.createDataFrame([("x",), ("x",), (None,)], "media_id string")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    rows = stream.stream_new_items(read(spark, landed), seen)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(2, "y", None)]
