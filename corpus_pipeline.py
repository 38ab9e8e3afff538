"""Training corpus from raw documents: five stages, each written as Parquet and read again.

Stages that run Python on texts write their rows themselves, in small Arrow batches: what
they return is run by the caller, under the session's batch size.

No SQL expresses the learnt and iterative stages, so ORACLE_SQL is None; the tests compare
a small run with a brute-force version of each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import bpe, mixing, ngram_join, pii, toxicity
from gistmill.llm.common import few_rows, load, materialize, shared_dir
from gistmill.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    with few_rows(spark):
        return materialize(toxicity.clean(docs, load(spark, sf_dir, "labels")), "clean")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; n_chars follows."""
    return pii.Sanitiser(docs).sanitised().withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id, source, n_tokens, ids``."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    with few_rows(spark):
        return materialize(bpe.encode_rows(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "source"]), "tokens")


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("pii", sanitise), ("mixing", mix_sources), ("bpe", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the folder that executors share."""
    docs, where = load(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
