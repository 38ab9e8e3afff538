"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) with x_i = 1 for a term
that the text has (Rendle, 2010). The factors learn pairs of terms, such as an insult with
the mention of a group, whose weights alone say little.

Terms are hashed into a table of 2**18 weights and factors. What the labels say nothing
about weighs nothing: a slot's weights are exact zeros unless its association with the label
passes the universal threshold (Donoho and Johnstone, 1994), at which hardly one slot of a
whole table of chance terms would pass. A second test at the same threshold is made among
the rows that hold such a term: it admits terms that are neutral alone but turn the meaning
of another (a pair is found if one of its terms says something alone). However many slots
pass, all are fitted. The fit uses a bounded sample of labelled rows (``MAX_ROWS``) and a
fixed number of steps; every whole text of the table is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import materialize, need, sized_join, slices
from gistmill.llm.quality import remainder

#: Most labelled rows that a fit uses, those with the smallest hashes.
MAX_ROWS = 20_000
HASH_BITS = 18
FACTORS = 4
STEMS = (4, 5, 6)
#: Steps of a fit and rows in each, whatever the number of rows.
STEPS, BATCH, RATE = 1200, 256, 0.05
#: Decay of a weight and of its factors.
DECAY = np.array([1e-4] + [1e-3] * FACTORS)
_LETTERS = bytes(c if 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def hashed_terms(text: str | None) -> np.ndarray:
    """Slots of the distinct lower-case words of a text and of their beginnings; words are runs of letters.

    Beginnings of 4 to 6 bytes let a stem count in all its forms.
    """
    words = set((text or "").lower().encode().translate(_LETTERS).split())
    stems = {w[:k] for k in STEMS for w in words if len(w) > k}
    crc, mask = zlib.crc32, (1 << HASH_BITS) - 1
    return np.array(sorted({crc(w) & mask for w in words} | {crc(w, 1) & mask for w in stems}), np.int32)


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All slots in a row, and the row of each."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return flat, np.repeat(np.arange(len(rows)), [len(r) for r in rows])


class Model:
    """Bias ``w0`` and the table ``theta``: a weight and ``FACTORS`` factors for each slot, zero for most."""

    def __init__(self, size: int = 1 << HASH_BITS):
        self.w0, self.size = 0.0, size
        self.slots, self.values = np.zeros(0, np.int32), np.zeros((0, FACTORS + 1), np.float32)
        self._theta: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_theta": None}  # only what is not zero is sent to tasks

    @property
    def theta(self) -> np.ndarray:
        if self._theta is None:
            self._theta = np.zeros((self.size, FACTORS + 1), np.float32)
            self._theta[self.slots] = self.values
        return self._theta

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        flat, row = _joined(rows)
        return self.w0 + self._sums(self.theta[flat], row, len(rows))[0]

    @staticmethod
    def _sums(t: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's margin without the bias, and its sum of factors."""
        s = np.stack([np.bincount(row, t[:, f], n) for f in range(1, FACTORS + 1)], 1)
        return np.bincount(row, t[:, 0] - 0.5 * (t[:, 1:] ** 2).sum(1), n) + 0.5 * (s * s).sum(1), s

    def fit(self, rows: list[np.ndarray], y: np.ndarray, pairs: bool = True, seed: int = 5) -> None:
        """Adam on the log loss over ``rows`` of slots, with weight decay, in mini-batches; the same rows give the same model.

        Without ``pairs`` the factors stay zero, which leaves logistic regression.
        """
        n, rng = len(rows), np.random.default_rng(seed)
        telling = association(rows, y, self.size) >= 2 * np.log(self.size)
        with_one = np.array([telling[r].any() for r in rows], bool)
        telling |= association([r for r, k in zip(rows, with_one, strict=True) if k], y[with_one], self.size) >= 2 * np.log(self.size)
        self.slots = np.flatnonzero(telling).astype(np.int32)
        place = np.full(self.size, -1, np.int32)
        place[self.slots] = np.arange(len(self.slots))
        rows = [(p := place[r])[p >= 0] for r in rows]
        theta = np.zeros((len(self.slots), FACTORS + 1))
        if pairs:
            theta[:, 1:] = rng.normal(0, 0.02, (len(self.slots), FACTORS))
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.w0, order = float(np.log(share / (1 - share))), np.zeros(0, np.int64)
        m, v, m0, v0 = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
        for step in range(1, STEPS + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(n)])
            at, order = order[:BATCH], order[BATCH:]
            flat, row = _joined([rows[i] for i in at])
            t = theta[flat]
            margin, s = self._sums(t, row, BATCH)
            err = (1 / (1 + np.exp(-np.clip(self.w0 + margin, -30, 30))) - y[at]) / BATCH
            of, grad = err[row], DECAY * theta
            grad[:, 0] += np.bincount(flat, of, len(theta))
            for f in range(1, FACTORS + 1) if pairs else ():
                grad[:, f] += np.bincount(flat, of * (s[row, f - 1] - t[:, f]), len(theta))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            m0, v0 = 0.9 * m0 + 0.1 * err.sum(), 0.99 * v0 + 0.01 * err.sum() ** 2
            one, two = 1 - 0.9**step, 1 - 0.99**step
            theta -= RATE * (m / one) / (np.sqrt(v / two) + 1e-6)
            self.w0 -= RATE * (m0 / one) / (np.sqrt(v0 / two) + 1e-6)
        self.values, self._theta = theta.astype(np.float32), None


def association(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """G, twice the log likelihood ratio, of each slot's rows against the label's share; zeros without rows or with one label only."""
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(size)
    total, ones = np.zeros(size), np.zeros(size)
    for at in range(0, len(rows), BATCH):
        flat, row = _joined(rows[at : at + BATCH])
        total += np.bincount(flat, minlength=size)
        ones += np.bincount(flat, y[at + row], size)

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, expected, 1))

    return 2 * (part(ones, total * share) + part(total - ones, total * (1 - share)))


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        terms = pa.array([hashed_terms(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), terms], ["doc_id", "label", "slots"])


def examples(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots and labels of at most ``MAX_ROWS`` rows of ``labels(doc_id, label)`` joined to ``docs(doc_id, text)``; ids with remainder 0 are held out, null labels and ids left out.

    Of rows that repeat an id and label the one with the smallest slots counts. The driver
    takes in one partition at a time.
    """
    labels = need(labels, ["doc_id", "label"]).where("label IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id")) != 0)
    labels = materialize(labels.select("doc_id", F.col("label").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(MAX_ROWS), "labels")
    # At most MAX_ROWS short rows, so that the join leaves the texts where they are.
    rows = sized_join(need(docs, ["doc_id", "text"]), labels, "doc_id", "inner").mapInArrow(_slots_of, "doc_id long, label double, slots binary")
    # A row for each labelled id, so the bound holds however often docs or labels repeat it.
    rows = materialize(rows.groupBy("doc_id", "label").agg(F.min("slots").alias("slots")), "slots")
    got = sorted((r["doc_id"], r["label"], bytes(r["slots"])) for r in rows.toLocalIterator())
    return [np.frombuffer(s, np.int32) for _, _, s in got], np.array([y for _, y, _ in got])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``examples``. With labels of one kind only every score is about their share; without any it is 0."""
    rows, y = examples(docs, labels)
    model = Model()
    if len(rows):
        model.fit(rows, y)
    else:
        model.w0 = -30.0
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value = 1 / (1 + np.exp(-np.clip(model.margins([hashed_terms(t.as_py()) for t in batch.column("text")]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = need(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from ``labels(doc_id, toxic)`` and scores every row of ``docs``.

    Null texts count as empty and get a score; repeated rows each give a row; further
    columns are not read; an empty table gives an empty result.
    """
    return score(docs, fit(docs, labels.select("doc_id", F.col("toxic").alias("label"))))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns as they are, without the rows whose text scores ``threshold`` or more.

    Null and empty texts are scored like others, by the bias alone; of repeated rows all go
    or all stay; null ids do not matter; an empty table gives an empty result.
    """
    model = fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.log(threshold / (1 - threshold))
        for batch in slices(batches):
            yield batch.filter(pa.array(model.margins([hashed_terms(t.as_py()) for t in batch.column("text")]) < edge))

    return docs.mapInArrow(run, docs.schema)
