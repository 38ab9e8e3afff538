"""Unions and de-duplication, by url and by fuzzy title."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from gistmill.shared import materialize, sized_join

#: Titles of a block at most; each two blocks that meet are a task's work. Blocks there are at least, if they have some hundred titles each.
BLOCK, LEAST_BLOCKS = 8192, 16
#: Characters that are counted each alone, classes that the others share, and times that a character is counted as ones.
ALONE, SHARED, LEVELS = 96, 64, 16
#: Numbers of a product of matrices, and pairs (or words of their bits) that are compared in order, held at once.
CELLS, PAIRS = 1 << 22, 1 << 14


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All sources with ``source_type``; columns that one lacks are null there."""
    tagged = [df.withColumn("source_type", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dedup_urls(articles: DataFrame) -> DataFrame:
    """The first row of each url by ``seq``; all rows without a url count as one.

    The smallest ``seq`` per url is a minimum, combined before the shuffle, so neither a hot
    url nor the empty one gathers rows in a task.
    """
    url = F.coalesce("url", F.lit(""))
    first = articles.groupBy(url.alias("__url")).agg(F.min("seq").alias("__seq"))
    return articles.join(first.select("__seq"), articles["seq"] == F.col("__seq"), "left_semi")


def clean_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[^\w\s]", "")), r"(?U)^\s+|\s+\z", "")


@pandas_udf(T.DoubleType())
def title_similarity(lower: pd.Series, higher: pd.Series) -> pd.Series:
    """Ratio of cleaned titles; the lower-ranked comes first, as the ratio depends on the order."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(lower, higher, strict=True)], dtype="float64")


def _codes(titles: list[str]) -> np.ndarray:
    return np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32)


def common_lengths(patterns: np.ndarray, columns: Iterable[np.ndarray], live: np.ndarray, alphabet: int, which: np.ndarray | None = None) -> np.ndarray:
    """Length of the longest common subsequence of a title with each of others, 64 of its characters to a word (Hyyrö's bits).

    ``columns`` gives the j-th character of every other title, the longest first, as places in
    the alphabet, and ``live[j]`` says how many have one; characters of a pattern that no other has
    are -1. With ``which`` there are several patterns, filled up with -1, and it names the one that
    each of the others is compared with.
    """
    patterns = np.atleast_2d(patterns)
    words = -(-patterns.shape[1] // 64)
    table = np.zeros((words, len(patterns) * alphabet), np.uint64)
    row, at = np.nonzero(patterns >= 0)
    np.bitwise_or.at(table, (at // 64, row * alphabet + patterns[row, at]), np.uint64(1) << (at % 64).astype(np.uint64))
    state = np.full((words, columns.shape[1] if which is None else len(which)), ~np.uint64(0))
    base = None if which is None else which * alphabet
    for column, n in zip(columns, live, strict=True):
        if not n:
            break
        key, carry = column[:n] if base is None else column[:n] + base[:n], None
        for w in range(words):
            v = state[w, :n]
            u = table[w].take(key, mode="clip")  # quicker than the check of each place
            u &= v
            total = v + u
            over = total < v if w + 1 < words else None
            if carry is not None:
                total += carry
                if over is not None:
                    over |= (total == 0) & carry
            v ^= u
            v |= total
            carry = over
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def _places(titles: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all titles as places in the alphabet, -1 where it lacks them, and where each title starts and how many it has."""
    sizes = np.array([len(t) for t in titles], np.int64)
    codes = _codes(titles)
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    return np.where(alphabet[at] == codes, at, -1), np.cumsum(sizes) - sizes, sizes


def _counts(places: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How often each title has each class of characters."""
    row = np.repeat(np.arange(len(sizes)), sizes)[places >= 0]
    many = int(classes.max(initial=0)) + 1
    return np.bincount(row * many + classes[places[places >= 0]], minlength=len(sizes) * many).reshape(-1, many)


def _bags(ones: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose inner products are at least the number of characters that two titles have in common, in any order.

    A class that a title has c times is c ones; what is beyond the count that 49 of 50 titles stay within
    is one number, and a product of two such numbers is no less than the smaller.
    """
    x, y, usual = [], [], np.quantile(others, 0.98, axis=0)
    for a, b, n in zip(ones.T, others.T, usual, strict=True):
        most = min(a.max(), b.max())
        top = min(most, max(1, int(n)), LEVELS)
        x += [a > k for k in range(top)]
        y += [b > k for k in range(top)]
        if top < most:
            x.append(np.maximum(a - top, 0))
            y.append(np.maximum(b - top, 0))
    return np.array(x, np.float32).reshape(len(x), len(ones)), np.array(y, np.float32).reshape(len(y), len(others))


def _near(ones: list[str], others: list[str], threshold: float, same: bool) -> Iterator[tuple[int, int]]:
    """Places of titles that may reach the threshold, as the ratio counts common characters in order; with ``same`` both lists are one, and its pairs are met once.

    The characters common in any order are counted first, by a product of matrices; pairs that have
    enough of them are compared in order.
    """
    alphabet, often = np.unique(_codes(others), return_counts=True)
    if not len(alphabet):
        return
    classes = np.empty(len(alphabet), np.int64)  # frequent characters stand alone, others share a class
    by_use = np.argsort(-often, kind="stable")
    classes[by_use] = np.where(np.arange(len(alphabet)) < ALONE, np.arange(len(alphabet)), ALONE + np.arange(len(alphabet)) % SHARED)
    order = np.array(sorted(range(len(ones)), key=lambda i: len(ones[i])))  # patterns of a length take equally many words
    own, own_start, own_size = _places([ones[i] for i in order], alphabet)
    far, far_start, far_size = _places(others, alphabet)
    x, y = _bags(_counts(own, own_size, classes), _counts(far, far_size, classes))
    need_x, need_y = ((threshold / 2 - 1e-6) * n - 0.01 for n in (own_size, far_size))
    x, y = np.vstack([x, -need_x, np.ones(len(ones))]).astype(np.float32), np.vstack([y, np.ones(len(others)), -need_y]).astype(np.float32)
    start = 0
    while start < len(ones):
        # So many patterns that their products and their bits stay small; the last is the longest.
        end = min(len(ones), start + max(1, CELLS // len(others)))
        words = -(-own_size[end - 1] // 64)
        end = min(end, start + max(1, CELLS // 2 // (len(alphabet) * words)))
        i, k = np.divmod(np.flatnonzero(x[:, start:end].T @ y >= 0), len(others))
        if same:
            i, k = (z[order[start + i] < k] for z in (i, k))
        sizes = own_size[start:end]
        patterns = np.full((end - start, sizes[-1]), -1)
        row = np.repeat(np.arange(end - start), sizes)
        patterns[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = own[own_start[start] : own_start[start] + len(row)]
        step = max(1, PAIRS // words)
        for first in range(0, len(i), step):
            a, b = i[first : first + step], k[first : first + step]
            for width in sorted({min(64, sizes[-1]), sizes[-1]}):  # one word first: what is beyond it adds its length at most
                if len(a):
                    by_size = np.argsort(-far_size[b], kind="stable")
                    a, b = a[by_size], b[by_size]
                    used, which = np.unique(a, return_inverse=True)
                    begin, n = far_start[b], far_size[b]
                    live = np.searchsorted(-n, -np.arange(n[0]), side="left")
                    columns = (far.take(begin[:m] + j) for j, m in enumerate(live))
                    common = common_lengths(patterns[used, :width], columns, live, len(alphabet), which) + np.maximum(sizes[a] - width, 0)
                    enough = 2 * common >= threshold * (sizes[a] + n) - 1e-9
                    a, b = a[enough], b[enough]
            yield from zip(order[start + a].tolist(), b.tolist(), strict=True)
        start = end


def _similar(threshold: float, schema: T.StructType):
    """Function over pairs of blocks ``a, b`` (``a`` is ``b`` where ``same``): ``lo, hi`` of pairs that reach the threshold, the worse row first."""

    def ranks(block) -> list[tuple]:
        return [(x["kind"], x["s"] if x["kind"] == 1 else 0, x["q"]) for x in block]

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, same in zip(batch["a"], batch["b"], batch["same"], strict=True):
                ones, others = [x["clean"] for x in a], [x["clean"] for x in b]
                rank_a, rank_b = ranks(a), ranks(b)
                near = _near(ones, others, threshold, same)
                while some := list(islice(near, PAIRS)):
                    pairs = [((i, a, b, k) if rank_a[i] > rank_b[k] else (k, b, a, i)) for i, k in some]
                    matcher, out = SequenceMatcher(None), []
                    for lo, low, high, hi in sorted(pairs, key=lambda p: p[2][p[3]]["clean"]):
                        if matcher.b != high[hi]["clean"]:
                            matcher.set_seq2(high[hi]["clean"])
                        matcher.set_seq1(low[lo]["clean"])
                        if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold:
                            out.append((low[lo]["q"], high[hi]["q"]))
                    yield pd.DataFrame(out, columns=schema.names)

    return similar


def dedup_titles_exact(articles: DataFrame, score: str = "raw_score") -> DataFrame:
    """The best row, by score and then ``seq``, of each cleaned title."""
    # Whole rows are kept in the aggregate, so that the articles are read and scored once.
    row = F.struct(*[F.col(f"`{c}`") for c in articles.columns])
    best = articles.groupBy(clean_title(F.col("title")).alias("__clean")).agg(F.max_by(row, F.struct(F.col(score), -F.col("seq"))).alias("__row"))
    return best.select(*[F.col("__row").getField(c).alias(c) for c in articles.columns])


def similar_titles(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Pairs ``(lo, hi)`` of ``q`` whose titles reach the threshold, the worse row first, from distinct titles ``clean`` with rank ``(s, q)``.

    Titles are dealt by length into blocks, and every two blocks whose lengths are near enough
    meet in a task, which holds these two alone. There a pair is dropped if the characters that it
    has in common are too few for the ratio, in any order or in the titles' order; what is left is
    measured.
    """
    rows = rows.where("clean <> ''").select(F.length("clean").alias("n"), "clean", "s", "q", F.when(F.col("s").isNull(), 0).when(F.isnan("s"), 2).otherwise(1).alias("kind"))
    count, characters = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    many = max(1, -(-count // block), -(-characters // (256 * BLOCK)), min(LEAST_BLOCKS, count // 512))
    dealt = materialize(rows.repartitionByRange(many, "n", "q").withColumn("block", F.spark_partition_id()), "dealt")
    blocks = materialize(dealt.groupBy("block").agg(F.collect_list(F.struct("clean", "s", "q", "kind")).alias("titles"), F.min("n").alias("least"), F.max("n").alias("most")), "blocks")
    share = threshold / (2 - threshold)
    ones = blocks.select(F.col("block").alias("i"), F.col("least").alias("least_i"))
    others = blocks.select(F.col("block").alias("k"), F.col("most").alias("most_k"))
    # Blocks rise in length, and the shorter titles of two blocks are the patterns, which take fewer words; a block is one small row here.
    meet = materialize(others.crossJoin(ones).where((F.col("k") <= F.col("i")) & (F.col("most_k") >= F.col("least_i") * share - 1e-9)).select("i", "k"), "meet")
    tasks = max(1, min(meet.count(), 2000))
    # Each block goes to the pairs that it is in by one shuffle.
    longer, shorter = (sized_join(blocks.select(F.col("block").alias(c), F.col("titles").alias(name)), meet, c, "inner").repartition(tasks, "i", "k") for c, name in (("i", "b"), ("k", "a")))
    pairs = longer.join(shorter.hint("merge"), ["i", "k"])
    schema = T.StructType([T.StructField(c, rows.schema["q"].dataType) for c in ("lo", "hi")])
    return pairs.select("a", "b", (F.col("i") == F.col("k")).alias("same")).mapInPandas(_similar(threshold, schema), schema)


def dedup_titles(articles: DataFrame, threshold: float = 0.75, score: str = "raw_score") -> DataFrame:
    """Rows that a greedy pass by score would keep: none is similar to a better row that is kept.

    Exact copies collapse first. Similar pairs are found by blocks, which loses none; then
    rounds decide rows whose better neighbours are all decided, until none is left. At a
    threshold of 0.75 no bound on the ratio leaves few candidates among titles of one
    alphabet, so the work on a whole table grows with its square, at the price of a product of
    vectors a pair; ``top_titles`` serves digests.
    """
    best = materialize(dedup_titles_exact(articles, score), "best")
    edges = materialize(similar_titles(best.select(clean_title(F.col("title")).alias("clean"), (-F.col(score)).alias("s"), F.col("seq").alias("q")), threshold), "edges")
    open_, dropped = edges, None
    while not open_.isEmpty():
        # Better rows of an open pair that are in no open pair as the worse one are kept; their worse neighbours go.
        kept = open_.select(F.col("hi").alias("r")).distinct().join(open_.select(F.col("lo").alias("r")).distinct(), "r", "left_anti")
        gone = materialize(open_.join(kept.withColumnRenamed("r", "hi"), "hi").select(F.col("lo").alias("r")).distinct())
        dropped = gone if dropped is None else dropped.unionAll(gone)
        open_ = materialize(open_.join(gone.withColumnRenamed("r", "lo"), "lo", "left_anti").join(gone.withColumnRenamed("r", "hi"), "hi", "left_anti").join(kept.withColumnRenamed("r", "hi"), "hi", "left_anti"))
    return best if dropped is None else best.join(dropped.select(F.col("r").alias("__seq")), best["seq"] == F.col("__seq"), "left_anti")


def top_titles(articles: DataFrame, n: int, threshold: float = 0.75, score: str = "raw_score") -> DataFrame:
    """The first ``n`` rows, by score and then ``seq``, that ``dedup_titles`` would keep, without the rest of its work.

    Whether a row is kept depends on better rows alone. So the best ``4 n`` rows are
    de-duplicated among themselves, and four times as many while fewer than ``n`` are kept
    and there are more: the result is that of the whole table.
    """
    many = 4 * n
    while True:
        best = materialize(articles.orderBy(F.desc(score), "seq").limit(many), "best")
        kept = materialize(dedup_titles(best, threshold, score).orderBy(F.desc(score), "seq").limit(n), "kept")
        if kept.count() >= n or best.count() < many:
            return kept
        many *= 4


def dedup_notes(notes: DataFrame) -> DataFrame:
    """One note per title, the one with the last path."""
    last = notes.groupBy("title").agg(F.max("rel_path").alias("rel_path"))
    return notes.join(last, ["title", "rel_path"], "left_semi")
