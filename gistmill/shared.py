"""Tables in the folder that driver and executors share, and joins whose broadcasts are bounded by bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a side may be broadcast; beyond it a join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode, where driver and executors
    are one process; on a cluster it must be set, and an error says so.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in Spark's rows, from above."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(24).cast("long"), lambda acc, x: acc + _width(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("long"), F.lit(16).cast("long"))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of ``df`` together have at most ``limit`` bytes, measured row by row."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return (df.agg(F.sum(row)).first()[0] or 0) <= limit


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts ``right`` only where its measured bytes are within ``limit``; otherwise it shuffles, and Spark splits skewed keys."""
    return left.join(F.broadcast(right) if small(right, limit) else right, on, how)
