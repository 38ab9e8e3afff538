"""Registered queries of the training-data operators; each returns its contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import align, ann, bpe, fixity, media, minhash, mixing, negatives, ngram_join, pii, preference, quality, toxicity
from gistmill.llm.common import load

#: Vocabulary and pattern of the byte-level BPE; parameters, never copied.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The two tokenizers that are aligned.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where("vec_id % 50 = 0"), vectors, k=5).select("query_id", "rank", "vec_id", "score")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_of_documents(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_items")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(load(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as kept, against a replica in which every 97th page has lost its last character."""
    pages = load(spark, sf_dir, "pages")
    copy = pages.withColumn("html", F.when(F.col("page_id") % 97 == 5, F.col("html").substr(F.lit(1), F.length("html") - 1)).otherwise(F.col("html")))
    return fixity.audit(fixity.pack(pages), fixity.pack(copy)).select("file", "ordinal", "expected", "found", "first_offset", "end_offset")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.Sanitiser(load(spark, sf_dir, "documents")).spans()


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.off_topic_pairs(load(spark, sf_dir, "conversations"))
    formed = preference.format_pairs(pairs)
    return formed.withColumns({m: F.array_join(m, ",") for m in ("chosen_mask", "rejected_mask")})


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(load(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", label.alias("label"), negatives.quantised(F.col("embedding")).alias("vector"))
    return negatives.mine(rows, rows.where("vec_id % 50 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ann, op2_media, op3_ngram_join, op4_mixing, op5_fixity, op6_quality, op7_toxicity, op8_bpe, op9_pii, op10_preference, op11_alignment, op12_minhash, op13_negatives, pipeline)}
