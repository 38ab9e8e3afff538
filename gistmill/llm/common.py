"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.shared import materialize, shared_dir, sized_join, small

__all__ = ["SLICE", "WORD", "few_rows", "load", "materialize", "ids_back", "ids_whole", "need", "numbered", "shared_dir", "sized_join", "slices", "small", "unwrap", "wrapped"]

#: Bytes of text that a task works on at a time.
SLICE = 1 << 20

#: A word of the contracts: a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def need(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that further columns of the caller can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def ids_whole(df: DataFrame, name: str) -> DataFrame:
    """``df`` with 0 for null ids and ``__no_id`` to tell them: pandas turns a column that holds a null into doubles, which lose the last bits of large ids."""
    return df.withColumns({name: F.coalesce(name, F.lit(0).cast("long")), "__no_id": F.col(name).isNull()})


def ids_back(df: DataFrame, name: str) -> DataFrame:
    """Undoes ``ids_whole``."""
    return df.withColumn(name, F.when(~F.col("__no_id"), F.col(name))).drop("__no_id")


def wrapped(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, beside which any name is free; ``unwrap`` turns it back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unwrap(df: DataFrame, row: str, columns: Iterable[str]) -> DataFrame:
    """The fields of the struct ``row`` as columns again."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in columns])


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``place``, 0 and on in the order of the given columns or expressions, which should tell rows apart.

    Rows are dealt out by ranges of the order and counted in each; only one count a range
    meets in one task.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__inside", inside).join(starts, "__part").withColumn("place", F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where their texts, or the values of another column, fill ``limit`` bytes, so that a task holds the work on so much text and not on a whole batch; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of that many rows at most for what runs inside; a batch of whole texts or sets is held by the executor, as one growing buffer, and by its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
