"""Merkle fixity audit of WARC records.

Records are hashed with SHA-256 and have their place by page id: a file holds 1,024
consecutive ids, in slots that are ordered as their offsets are. 16 slots form a range, 16
ranges a range of ranges, up to the file's root, and files' roots are folded in the same way
into the replica's root. Two replicas are compared by their roots first; only where these
differ are hashes of the next level read, and of these only the children of nodes that
differ. So equal replicas end at one comparison, the work of an audit follows the damage,
and a lost record shows as itself, as no other moves out of its slot.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.llm.common import materialize, need, sized_join

FANOUT = 16
#: Slots to a file when pages are packed into WARC files.
FILE_RECORDS = 1024
#: Files over which pages without an id are dealt out by their digest; they come before file 0.
NAMELESS = 256
VERSION = "WARC/1.1\r\n"
KEYS = ("file", "node")


def record(url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record of a page; nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit(f"{VERSION}WARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC/1.1 files, plain or gzipped: ``path, position, type, url, content_length, block, digest, length, complete``.

    Spark splits the files at the version line, so a large plain file is read by many
    tasks. ``block`` is binary, ``digest`` is of the whole record, ``position`` counts from 0
    in each file. ``complete`` is false where the block is not as long as its header says:
    the record is truncated, or its block holds a version line itself.
    """
    raw = spark.read.text(path, lineSep=VERSION).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value").where("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    field = lambda name: F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    size = field("Content-Length").try_cast("int")
    rows = raw.withColumns({"type": field("WARC-Type"), "url": field("WARC-Target-URI"), "content_length": size, "start": F.octet_length(head) + 4, "bytes": F.col("value").cast("binary")})
    whole = F.octet_length("bytes") == F.col("start") + F.col("content_length") + 4
    # Only names and places of records are sorted by file, never the records.
    place = F.row_number().over(Window.partitionBy("path").orderBy("at")).cast("long") - 1
    rows = rows.join(raw.select("path", "at").withColumn("position", place).select("at", "position"), "at")
    digest = F.sha2(F.concat(F.encode(F.lit(VERSION), "UTF-8"), F.col("bytes")), 256)
    return rows.select("path", "position", "type", "url", "content_length", F.substring("bytes", F.col("start") + 1, F.coalesce("content_length", F.lit(0))).alias("block"), digest.alias("digest"), (F.octet_length("bytes") + len(VERSION)).cast("long").alias("length"), F.coalesce(whole, F.lit(False)).alias("complete"))


def _hex(digest: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def pack(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as records in place: ``file, ordinal, page_id, records, offset, length, digest``.

    Page ``i`` has slot ``i % 1024`` of file ``i // 1024``. Rows that repeat an id share its
    slot, whose digest is then that of their number and the sums of their digests' parts, so
    that even very many are only added up. Ids may have any sign and size; files of negative
    ids have negative numbers. Pages with a null id get file (one of 256 with
    negative numbers) and slot by their digest. Null url and html count as empty, further
    columns are not read, and an empty table gives an empty result. Only hashes and lengths
    are shuffled, never the pages.
    """
    raw = record(F.col("url"), F.col("html"))
    rows = need(pages, ["page_id", "url", "html"]).select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(raw).cast("long").alias("length"), F.sha2(F.encode(raw, "UTF-8"), 256).alias("digest"))
    known = F.col("page_id").isNotNull()
    rows = rows.select(
        F.when(known, F.shiftright("page_id", FILE_RECORDS.bit_length() - 1)).otherwise(_hex(F.col("digest"), 1, 2) - NAMELESS).alias("file"),
        F.when(known, F.pmod("page_id", F.lit(FILE_RECORDS))).otherwise(_hex(F.col("digest"), 3, 8) % FILE_RECORDS).alias("ordinal"),
        "page_id", "length", "digest",
    )
    parts = [F.sum(_hex(F.col("digest"), at, 15).cast("decimal(20,0)")).cast("string") for at in (1, 16, 31, 46, 61)]
    several = F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256)
    slots = rows.groupBy("file", "ordinal").agg(F.min("page_id").alias("page_id"), F.count("*").alias("records"), F.sum("length").alias("length"), F.when(F.count("*") == 1, F.min("digest")).otherwise(several).alias("digest"))
    before = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # at most 1,024 slots
    return slots.select("file", "ordinal", "page_id", "records", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def _fold(level: DataFrame, up: tuple[Column, Column]) -> DataFrame:
    """The level above: nodes of at most 16 children, whatever there is."""
    child = F.struct(*KEYS, "digest")
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["digest"]), ""), 256)
    return level.groupBy(up[0].alias("file"), up[1].alias("node")).agg(digest.alias("digest"), F.min("first_offset").alias("first_offset"), F.max("end_offset").alias("end_offset"))


def _parent(height: int) -> tuple[Column, Column]:
    """Key of the node above, for a node of that height; a file's root has height 3."""
    if FANOUT**height < FILE_RECORDS:
        return F.col("file"), F.floor(F.col("node") / FANOUT)
    # Whole shifts keep all bits. Files below zero end at -1, which goes to the node above file 0.
    return F.when(F.col("file") == -1, 0).otherwise(F.shiftright("file", FANOUT.bit_length() - 1)).cast("long"), F.lit(0).cast("long")


def height(records: DataFrame) -> int:
    """Levels above the records that lead to one root, whatever the signs of the files."""
    row = records.agg(F.min("file"), F.max("file")).first()
    ends, levels = {(x or 0) + NAMELESS for x in row}, 0
    while FANOUT**levels < FILE_RECORDS:
        levels += 1
    while ends != {0}:
        ends, levels = {0 if x == -1 else x // FANOUT for x in ends}, levels + 1
    return levels


def tree(records: DataFrame, levels: int | None = None) -> list[DataFrame]:
    """Levels ``(file, node, digest, first_offset, end_offset)``: records first, the replica's root last; files are counted from the nameless ones on."""
    now = records.select((F.col("file") + NAMELESS).alias("file"), F.col("ordinal").alias("node"), "digest", F.col("offset").alias("first_offset"), (F.col("offset") + F.col("length")).alias("end_offset"))
    out = [materialize(now, "merkle")]
    for up in range(height(records) if levels is None else levels):
        out.append(materialize(_fold(out[-1], _parent(up)), "merkle"))
    return out


def root(levels: list[DataFrame]) -> str | None:
    """The replica's root hash, one short string; None if it has no records."""
    rows = levels[-1].limit(2).collect()
    if len(rows) > 1:
        raise ValueError("the tree has more than one root")
    return rows[0]["digest"] if rows else None


def audit(kept: DataFrame, copy: DataFrame) -> DataFrame:
    """Records in which two replicas differ: ``file, ordinal, expected, found, first_offset, end_offset, levels``.

    Both are tables as ``pack`` makes them. A record that only one replica has shows with a
    null on the other side; equal replicas, and two empty ones, give no rows. ``levels`` is
    how many levels of hashes lie above a record.
    """
    kept, copy = materialize(kept, "kept"), materialize(copy, "copy")
    levels = max(height(kept), height(copy))
    one, two = tree(kept, levels), tree(copy, levels)
    sides = lambda at: (x.select(*KEYS, F.col("digest").alias(d), F.col("first_offset").alias(f"{d}_from"), F.col("end_offset").alias(f"{d}_to")) for x, d in ((one[at], "expected"), (two[at], "found")))
    differs = ~F.col("expected").eqNullSafe(F.col("found"))
    if root(one) == root(two):
        a, b = sides(0)
        suspects = a.limit(0).join(b.limit(0), [*KEYS], "full")
    else:
        a, b = sides(levels)
        suspects = a.join(b, [*KEYS], "full").where(differs)
        for at in range(levels - 1, -1, -1):
            above = materialize(suspects.select(F.col("file").alias("up_file"), F.col("node").alias("up_node")), "suspects")
            file, node = _parent(at)
            a, b = (sized_join(x, above, (file == F.col("up_file")) & (node == F.col("up_node")), "left_semi") for x in sides(at))
            suspects = a.join(b, [*KEYS], "full").where(differs)
    return suspects.select((F.col("file") - NAMELESS).alias("file"), F.col("node").alias("ordinal"), "expected", "found", F.coalesce("expected_from", "found_from").alias("first_offset"), F.coalesce("expected_to", "found_to").alias("end_offset"), F.lit(levels).alias("levels"))
