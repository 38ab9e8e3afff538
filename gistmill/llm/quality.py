"""Quality classifier: ridge regression on random Fourier features of document statistics.

The cosines of random projections approximate a Gaussian kernel (Rahimi and Recht, 2007).
Partitions sum their parts of the normal equations, the driver solves one small system,
and an isotonic fit on a fold kept apart turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import ids_back, ids_whole, materialize, need, sized_join

#: Most labelled rows that a fit uses, those with the smallest hashes.
MAX_ROWS = 60_000
FOURIER, PARTS, BINS = 192, 12, 1000
_DIGIT, _UPPER = slice(48, 58), slice(65, 91)
_MARKS = [ord(c) for c in "%&$#*|!~^<>{}[]@=+_\\/"]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text, none of which knows its language or words."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    distinct = set(words)
    pairs = set(zip(words, words[1:], strict=False))
    p = bytes_[bytes_ > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return np.array([
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        lengths.max() / 100,
        len(distinct) / n,
        len(distinct) / np.sqrt(n),
        len(pairs) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        bytes_[_MARKS].sum() / n,
        bytes_[124] / n,
        (bytes_[46] + bytes_[44]) / n,
        bytes_[_DIGIT].sum() / size,
        bytes_[_UPPER].sum() / n,
        bytes_[128:].sum() / size,
        bytes_[10] / n,
        1 - len(set(lines)) / len(lines),
        -(p * np.log2(p)).sum(),
        (lengths <= 3).mean(),
    ], np.float32)


N_STATS = len(statistics(""))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "__no_id": pdf["__no_id"], "stats": [statistics(t) for t in pdf["text"]]})


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` for every row of ``docs(doc_id, text)``; null texts count as empty."""
    rows = ids_whole(need(docs, ["doc_id", "text"]), "doc_id")
    return materialize(ids_back(rows.mapInPandas(_measure, "doc_id long, __no_id boolean, stats array<float>"), "doc_id"), "stats")


class Model:
    """Standardisation, projection, ridge weights and the steps of the isotonic fit."""

    def __init__(self, seed: int = 11, width: float = 3.0):
        rng = np.random.default_rng(seed)
        self.w = rng.standard_normal((N_STATS, FOURIER)) / width
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)
        self.mean, self.std, self.beta = np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FOURIER + N_STATS + 1)
        self.steps_x, self.steps_y = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -8, 8)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(x @ self.w + self.b), 0.1 * x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(stats) @ self.beta, -1, 2)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps_x, self.steps_y)


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf["stats"].to_list()).astype(np.float64), pdf["label"].to_numpy(np.float64)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((3, N_STATS))
    for pdf in batches:
        x, _ = _rows(pdf)
        total += np.stack([np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)])
    yield pd.DataFrame({"part": [total.tobytes()]})


def _equations(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(model.beta)
        total = np.zeros((width + 1, width))
        for pdf in batches:
            x, y = _rows(pdf)
            z = model.fourier(x)
            total[:-1] += z.T @ z
            total[-1] += z.T @ y
        yield pd.DataFrame({"part": [total.tobytes()]})

    return run


def _add(rows: DataFrame, f, shape: tuple) -> np.ndarray:
    """Sum of the parts, one for each of a fixed number of partitions."""
    return sum((np.frombuffer(x[0]).reshape(shape) for x in rows.mapInPandas(f, "part binary").collect()), np.zeros(shape))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted fit to points in the order of x, by pooling neighbours."""
    blocks: list[list[float]] = []
    for yi, wi in zip(y, w, strict=True):
        blocks.append([yi, wi, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, ridge: float = 1e-3) -> Model:
    """Fits on ``labels(doc_id, label)`` joined to ``stats``, of which ids with remainder 0 are held out.

    At most ``MAX_ROWS`` labelled rows are used. Remainder 1 is the fold for calibration.
    Null labels and ids are left out. Without any label every score is 0.5.
    """
    model = Model()
    labels = need(labels, ["doc_id", "label"]).where("label IS NOT NULL AND doc_id IS NOT NULL").withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 0")
    labels = materialize(labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MAX_ROWS), "labels")
    rows = materialize(sized_join(stats, labels, "doc_id", "inner").repartition(PARTS, "doc_id"), "train")
    train, apart = rows.where("fold <> 1"), rows.where("fold = 1")
    n, s, ss = _add(train, _sums, (3, N_STATS))
    if not n[0]:
        return model
    model.mean = s / n
    model.std = np.sqrt(np.maximum(ss / n - model.mean**2, 1e-6))
    equations = _add(train, _equations(model), (len(model.beta) + 1, len(model.beta)))
    model.beta = np.linalg.solve(equations[:-1] + (ridge * n[0] + 1e-6) * np.eye(len(model.beta)), equations[-1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = _rows(pdf)
            yield pd.DataFrame({"bin": np.round(model.raw(x) * BINS).astype(np.int64), "label": y})

    bins = apart.mapInPandas(binned, "bin long, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()  # at most 3,001 bins
    if bins:
        x, y, w = (np.array([r[i] for r in bins], float) for i in range(3))
        # Half a row of each label on top keeps scores off 0 and 1 where bins are few.
        model.steps_x, model.steps_y = x / BINS, isotonic(x, (y * w + 0.5 * y.mean()) / (w + 0.5), w)
    else:
        model.steps_x, model.steps_y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``stats``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                value = np.clip(model.score(np.stack(pdf["stats"].to_list()).astype(np.float64)), 0, 1)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "__no_id": pdf["__no_id"], "score": value, "predicted": (value >= threshold).astype(np.int32)})

    scored = ids_whole(stats.select("doc_id", "stats"), "doc_id").mapInPandas(run, "doc_id long, __no_id boolean, score double, predicted int")
    return ids_back(scored, "doc_id").select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from ``labels(doc_id, quality)`` and scores every row of ``docs(doc_id, text)``.

    Labels, language, source and id are no inputs of a score. Empty texts get a score too;
    repeated rows each give a row; an empty table gives an empty result.
    """
    stats = measure(docs)
    return score(stats, fit(stats, labels.select("doc_id", F.col("quality").alias("label"))))
