"""Approximate nearest neighbours by randomly rotated one-bit codes.

Public method: RaBitQ (Gao and Long, 2024). Every unit vector is turned by a fixed random
rotation into ``bits`` dimensions and kept as the packed signs plus one correction scalar,
the inner product of the turned vector with its own code. From these an inner product with
a query is estimated without bias, with an error bound that shrinks with the number of
bits; only vectors whose upper bound reaches the k-th best lower bound of their block are
compared exactly.

Layout: the scan packs vectors into blocks of at most one Arrow batch without a shuffle;
queries form blocks of ``BLOCK_BYTES``. Index blocks are dealt out over ``SPREAD`` parts, of
which each gets every query block once, and each pair of blocks meets once by an equi-join
on part and query block, which shuffles both. So the index moves once for each query block
of 8 MB (16,384 queries of 64 dimensions), and a part of it is never more than a share of the
whole. A block pair returns at most k rows a query, so what is shuffled at the end is
(queries x blocks x k) short rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import materialize, need

#: Bytes of a block of queries, parts of the index, estimates that a task holds at a time, and tasks of the search.
BLOCK_BYTES, SPREAD, CELLS, MOST_TASKS = 8 << 20, 64, 4 << 20, 4096
BLOCK_SCHEMA = "ids binary, vectors binary, codes binary, scalars binary, dim int"


def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """(dim, bits) matrix with orthonormal rows, equal wherever it is made."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))[0].T.astype(np.float32)


def _usable(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors that take part: not null, not zero, with finite components only."""
    ids, vectors = [], []
    for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
        if v is None or i is None or i != i or not len(v):
            continue
        x = np.asarray(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            ids.append(int(i))
            vectors.append(x)
    return np.array(ids, np.int64), vectors


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: exact, and no square over- or underflows for it."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _encode(bits: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, vectors = _usable(pdf)
            dims = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([vectors[i] for i in at])
                turned = _scaled(x).astype(np.float32)
                turned = (turned / np.linalg.norm(turned, axis=1, keepdims=True)) @ rotation(int(dim), max(bits, int(dim)), seed)
                scalars = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
                yield pd.DataFrame({"ids": [ids[at].tobytes()], "vectors": [x.tobytes()], "codes": [np.packbits(turned > 0, axis=1).tobytes()], "scalars": [scalars.astype(np.float32).tobytes()], "dim": [int(dim)]})

    return run


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed component by component, so that equal vectors get equal scores."""
    x, q = _scaled(x), _scaled(q)
    dot, xx, qq = np.zeros(len(x)), np.zeros(len(x)), 0.0
    for j in range(len(q)):
        dot += x[:, j] * q[j]
        xx += x[:, j] * x[:, j]
        qq += q[j] * q[j]
    return np.clip(dot / np.sqrt(xx * qq), -1.0, 1.0)


def _search(bits: int, seed: int, k: int, sigmas: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                dim, width = row.dim, max(bits, row.dim)
                ids, qids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                x, q = np.frombuffer(row.vectors).reshape(-1, dim), np.frombuffer(row.q_vectors).reshape(-1, dim)
                code = np.unpackbits(np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1), axis=1, count=width).astype(np.float32) * 2 - 1
                own = np.maximum(np.frombuffer(row.scalars, np.float32), 1e-6)
                unit = _scaled(q)
                unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32) @ rotation(dim, width, seed)
                error = sigmas * np.sqrt(np.maximum(1 - own * own, 0) / (own * own)) / np.sqrt(max(width - 1, 1))
                out, rows = [], max(1, CELLS // max(len(ids), 1))
                for i in range(len(qids)):
                    if i % rows == 0:
                        guesses = unit[i : i + rows] @ code.T / (np.sqrt(width) * own)
                    guess, other = guesses[i % rows], ids != qids[i]
                    low = np.where(other, guess - error, -np.inf)
                    least = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                    at = np.flatnonzero(other & (guess + error >= least))
                    score = cosines(x[at], q[i])
                    best = np.lexsort((ids[at], -score))[:k]
                    out.append((np.full(len(best), qids[i]), ids[at][best], score[best], np.full(len(best), len(at))))
                if out:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "compared"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def build_index(vectors: DataFrame, bits: int = 256, seed: int = 7) -> DataFrame:
    """Blocks of one-bit codes with the vectors they stand for; every usable row of ``vectors(vec_id, embedding)``."""
    return need(vectors, ["vec_id", "embedding"]).where("vec_id IS NOT NULL").mapInPandas(_encode(bits, seed), BLOCK_SCHEMA)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, bits: int = 256, sigmas: float = 1.9, seed: int = 7) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each of ``queries`` by cosine: ``query_id, rank, vec_id, score, compared``.

    Both tables have ``vec_id`` and ``embedding``; rows with the query's own vec_id are no
    candidates. Ties go to the smaller vec_id. Null, zero and non-finite vectors and null
    ids take no part; vectors of another length than the query's are no candidates;
    repeated rows count as often as they occur. ``compared`` is the number of exact
    comparisons in the block of the row. Empty tables give an empty result.
    """
    index = build_index(vectors, bits, seed)
    rows = need(queries, ["vec_id", "embedding"]).where("vec_id IS NOT NULL")  # a null would turn the ids of its batch into doubles
    size = rows.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
    many = max(1, -(-size // BLOCK_BYTES))
    rows = rows.repartition(many, F.xxhash64("vec_id"))
    packed = rows.mapInPandas(_encode(bits, seed), BLOCK_SCHEMA).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.monotonically_increasing_id().alias("q_block"))
    packed = materialize(packed, "queries")
    parts = packed.select(F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"), "q_block", "dim", "q_ids", "q_vectors")
    # The numbers of the query blocks, a few bytes for each 8 MB of queries, name what an index block has to meet.
    numbers = packed.groupBy("dim").agg(F.collect_list("q_block").alias("q_blocks"))
    met = index.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPREAD)).cast("int")).join(F.broadcast(numbers), "dim").withColumn("q_block", F.explode("q_blocks")).drop("q_blocks")
    # A copy of the queries for each part is no small side, however few bytes the table has from which it is unfolded:
    # a broadcast would take all copies through the driver. The parts stay as many tasks, as a pair of blocks is much work for its bytes.
    tasks = min(SPREAD * many, MOST_TASKS)
    met = met.repartition(tasks, "part", "q_block").join(parts.drop("dim").repartition(tasks, "part", "q_block").hint("merge"), ["part", "q_block"]).drop("part")
    found = met.drop("q_block").mapInPandas(_search(bits, seed, k, sigmas), "query_id long, vec_id long, score double, compared long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


def brute_force(queries: pd.DataFrame, vectors: pd.DataFrame, k: int = 5) -> pd.DataFrame:
    """Exact answer for small tables, to measure recall."""
    ids, x = _usable(vectors)
    qids, q = _usable(queries)
    out = []
    for i, v in zip(qids, q, strict=True):
        at = [j for j in range(len(ids)) if ids[j] != i and len(x[j]) == len(v)]
        if at:
            score = cosines(np.stack([x[j] for j in at]), v)
            best = np.lexsort((ids[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": i, "rank": np.arange(1, len(best) + 1), "vec_id": ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "rank", "vec_id", "score"])
