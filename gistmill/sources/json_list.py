"""Large JSON lists as rows: one file is read by as many tasks as its bytes fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.shared import materialize, sized_join


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Texts that end at closing braces, in order within a block of a file, and what each would do outside and inside a string.

    ``quotes`` is 1 where the chunk turns inside to outside or back; ``d0`` and ``d1`` are the
    braces that it leaves open when it starts outside or inside a string. A chunk never ends
    between a backslash and what it escapes, as a brace is never escaped.
    """
    rows = spark.read.text(path, lineSep="}")
    rows = rows.select(F.col("_metadata.file_path").alias("landed"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("chunk"))
    rows = rows.withColumn("__parts", F.split(F.regexp_replace("chunk", r"(?s)\\.", ""), '"')).withColumn("quotes", (F.size("__parts") - 1) % 2)

    def left_open(start: int):
        outside = F.array_join(F.filter("__parts", lambda _, i: i % 2 == start), "")
        opened = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
        return opened - F.when((F.col("quotes") + start) % 2 == 0, 1).otherwise(0)

    return rows.withColumns({"d0": left_open(0), "d1": left_open(1)}).drop("__parts")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``landed, pos, payload``: the objects of each JSON list under ``path`` by place, as text.

    Files are cut into blocks as any text. A first pass sums each block up for both cases, that
    it starts inside a string and that it does not; the sums, one row a block, tell what holds
    where each block starts; a second pass finds the braces that end an object, and its chunks
    are joined again. Members that are no objects are skipped. A list that was cut off gives
    the objects before the cut; an empty file or list gives none.
    """
    chunks = _chunks(spark, path)
    within, files = Window.partitionBy("landed", "block").orderBy("id"), Window.partitionBy("landed").orderBy("block")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    turned = chunks.withColumn("inside", inside)
    either = {"e0": F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")), "e1": F.when(F.col("inside") == 0, F.col("d1")).otherwise(F.col("d0"))}
    turned = turned.withColumns(either).drop("d0", "d1")

    blocks = turned.groupBy("landed", "block").agg((F.sum("quotes") % 2).alias("odd"), F.sum("e0").alias("e0"), F.sum("e1").alias("e1"))
    blocks = blocks.withColumn("start", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn("last", F.lead("block").over(files).isNull())
    blocks = blocks.withColumn("depth", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("e0")).otherwise(F.col("e1"))).over(earlier), F.lit(0)))
    starts = materialize(blocks.select("landed", "block", "start", "depth", "last"), "starts")

    rows = sized_join(turned, starts, ["landed", "block"], "inner")
    depth = F.col("depth") + F.sum(F.when(F.col("start") == 0, F.col("e0")).otherwise(F.col("e1"))).over(within)
    outside = (F.col("start") + F.col("inside") + F.col("quotes")) % 2 == 0
    # What follows the last brace of a file was not ended by one.
    tail = F.col("last") & F.lead("id").over(within).isNull()
    ended = rows.select("landed", "block", "id", "chunk", (outside & (depth == 0) & ~tail).alias("ends"))
    marked = materialize(ended.withColumn("object", F.coalesce(F.sum(F.col("ends").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "chunks")

    counts = marked.groupBy("landed", "block").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    offsets = materialize(counts.select("landed", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "offsets")
    placed = sized_join(marked, offsets, ["landed", "block"], "inner").withColumn("pos", F.col("offset") + F.col("object"))
    whole = placed.groupBy("landed", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "id", "chunk"))).alias("x"), F.max("ends").alias("ends")).where("ends")
    text = F.concat(F.array_join(F.transform("x", lambda c: c["chunk"]), "}"), F.lit("}"))
    return whole.select("landed", "pos", F.regexp_replace(text, r"^[^{]*", "").alias("payload"))
