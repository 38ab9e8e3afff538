"""Ids beyond 2^53 beside nulls, and ids of both signs."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from gistmill.llm import ann, fixity, media, quality

BIG = 2**53 + 1


def test_large_ids_keep_their_bits_beside_nulls(spark):
    vectors = spark.createDataFrame([(BIG, [1.0, 0.0]), (None, [1.0, 1.0]), (BIG + 1, [1.0, 0.5])], "vec_id long, embedding array<float>").coalesce(1)
    got = ann.nearest(vectors, vectors).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(BIG, BIG + 1), (BIG + 1, BIG)}
    texts = spark.createDataFrame([(BIG, "a b"), (None, "c"), (BIG + 2, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in media.media_of_documents(texts.withColumn("source", F.lit("s"))).collect()} == {BIG, None, BIG + 2}
    sequences = media.interleave(texts.withColumnRenamed("text", "html")).collect()
    assert {r.doc_id: len(r["items"]) for r in sequences} == {BIG: 1, None: 1, BIG + 2: 0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = texts.unionByName(spark.createDataFrame([(i, "word " * (i % 2 * 50 + 1)) for i in range(40)], "doc_id long, text string")).coalesce(1)
    assert {BIG, None, BIG + 2} <= {r.doc_id for r in quality.classify(docs, labels).collect()}


@pytest.mark.parametrize("ids", [[*range(50), *range(-300_000, -299_950), -5_000_000], [-BIG, BIG, 2**63 - 1, -(2**63), None, -1]])
def test_damage_is_found_whatever_the_signs(spark, ids):
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in ids], "page_id long, url string, html string")
    kept = fixity.pack(pages)
    i = rng.choice([x for x in ids if x is not None])
    copy = fixity.pack(pages.withColumn("html", F.when(F.col("page_id") == i, "bad").otherwise(F.col("html"))))
    assert [(r.file, r.ordinal) for r in fixity.audit(kept, copy).collect()] == [(i // 1024, i % 1024)]


def test_gzipped_warc_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * i) for i in range(30)], "page_id long, url string, html string")
    raw = "".join(r.value for r in pages.orderBy("page_id").select(fixity.record(F.col("url"), F.col("html")).alias("value")).collect()).encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "b.warc").write_bytes(raw)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = fixity.read_warc(spark, str(tmp_path)).collect()
    by = {(r.path.rsplit("/", 1)[-1], r.position): bytes(r.block).decode() for r in got}
    assert by == {(name, i): "x" * i for name in ("a.warc.gz", "b.warc") for i in range(30)}
