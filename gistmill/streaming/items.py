"""Continuous forms: new items, scores of what arrives, and a digest per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gistmill.functions.scoring import depth_level, depth_score

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_items(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key pass, by ``order``, and remembers that it did; keys of the initial state never pass."""

    def __init__(self, order: str | None):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "once boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, known = None, self.seen.exists()
        for pdf in rows:  # only the best row so far is held
            if not known and len(pdf):
                one = pdf.loc[[pdf[self.order].idxmin()]] if self.order else pdf.head(1)
                if best is None or (self.order and one[self.order].iloc[0] < best[self.order].iloc[0]):
                    best = one
        if best is not None:
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def _fresh(items: DataFrame) -> DataFrame:
    return items.where("media_id IS NOT NULL AND folder_id IS NULL")


def stream_new_items(items: DataFrame, seen: DataFrame | None = None, within: str | None = None, order: str | None = "seq") -> DataFrame:
    """Items whose media_id has not passed before; rows of folders never pass.

    With ``seen(media_id)`` the ids are a keyed state that starts from that table, so a stream
    with a new checkpoint does not repeat what an earlier one let pass; of the rows of a key
    in a batch the first by ``order`` passes. This needs the RocksDB state store, which is set
    for the session. Without it, every id is remembered for good, or with ``within`` (an
    interval, for a stream that has a watermark on ``ts``) for that time.
    """
    rows = _fresh(items)
    if seen is None:
        return rows.withWatermark("ts", within).dropDuplicatesWithinWatermark(["media_id"]) if within else rows.dropDuplicates(["media_id"])
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    before = seen.select("media_id").where("media_id IS NOT NULL").distinct().groupBy("media_id")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    return rows.groupBy("media_id").transformWithStateInPandas(FirstSeen(order if order in rows.columns else None), schema, "Append", "None", before)


def sync_items(items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """One incremental sync: items that no earlier sync into ``path`` passed go to ``path/items``, and each batch stamps ``path/sync``.

    A batch is written under the name of its sync and number, so a repeated batch replaces
    its own. The state starts from the ids in ``path/items``; a sync that has a checkpoint
    goes on from there.
    """
    spark, run = items.sparkSession, checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def each(batch: DataFrame, number: int) -> None:
        name = f"{run}-{number}"
        batch.write.mode("overwrite").parquet(f"{path}/items/sync={name}")
        kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/items/sync={name}")
        kept.agg(F.count("*").alias("n"), F.current_timestamp().alias("last_sync")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sync/sync={name}")

    fresh = stream_new_items(items, seen_items(spark, path))
    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def seen_items(spark: SparkSession, path: str) -> DataFrame:
    """``media_id`` of all items that syncs into ``path`` let pass; none before the first."""
    if not _exists(spark, f"{path}/items"):
        return spark.createDataFrame([], "media_id string")
    return spark.read.schema("media_id string").parquet(f"{path}/items").select("media_id")


def last_sync(spark: SparkSession, path: str) -> DataFrame:
    """``last_sync, items, batches``: when the last batch ended, and what all of them let pass; null and zeros before the first."""
    schema = "n long, last_sync timestamp"
    rows = spark.read.schema(schema).parquet(f"{path}/sync") if _exists(spark, f"{path}/sync") else spark.createDataFrame([], schema)
    return rows.agg(F.max("last_sync").alias("last_sync"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count("*").alias("batches"))


def stream_score(articles: DataFrame, least: float = 0.0) -> DataFrame:
    """Depth score and level of each article as it arrives, and the gate; no state."""
    # Unfolded from an array, so that the gate, which Spark would move before the score, doesn't make it a second time.
    score = F.filter(F.array(depth_score(F.coalesce("content", "summary", "title"))), lambda s: s >= least)
    return articles.withColumn("score", F.explode(score)).withColumn("level", depth_level(F.col("score")))


def stream_digest_batches(articles: DataFrame, digest: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """One whole digest for each batch, written under the batch's number, so that a repeated batch replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        digest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return articles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
