"""Hard-negative mining by cover trees over norm-augmented candidates.

Vectors are integers, so scores are exact. A candidate x of a tree whose largest norm is M
gets the further component sqrt(M^2 - |x|^2), and a query a zero there; then the distance
d of the two gives their inner product, (|q|^2 + M^2 - d^2) / 2. A node of a cover tree has
one of its vectors as centre and a covering radius, the largest distance of its vectors from
the centre, so its inner products with a query lie in an interval. Radii halve from level to
level; a level at which a node would only have one child is skipped.

Layout: each vector goes to the nearest of at most ``CELLS`` centres, fitted on a sample of
at most ``SAMPLE`` rows, the upper level of the cover; cells are cut by a salt into parts of
bounded size, so a vector that a third of all rows repeat fills several parts. A part holds
trees of at most ``TREE`` rows. Each part moves once and stays in its task while the query
blocks, a copy for each part, stream past it. Two rounds of this: the first finds positives,
the second, for the windows that the positives give, negatives. Within a tree the nodes with
the highest bounds are opened first; nodes that lie outside every window, hold the wrong
label alone or can't reach the k-th best are skipped, and leaves are compared exactly. So
nothing is lost; the sample and the cells affect cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import materialize, need

#: Rows that the upper centres are fitted on, and their number.
SAMPLE, CELLS = 4096, 64
#: Rows of a tree and of a leaf, numbers in a part at most, parts that a table is cut into at least where it has a tree for each.
TREE, LEAF, PART_NUMBERS, PARTS = 4096, 32, 1 << 22, 64
#: Bytes of a block of queries; nodes opened at a time.
BLOCK_BYTES, STEP = 4 << 20, 64
#: Squared norms have to stay below this, so that every inner product fits 64 bits.
LIMIT = float(1 << 62)
#: Below it inner products in doubles are exact.
EXACT = 1 << 52

TREE_SCHEMA = "part long, dim int, ids binary, labels binary, points binary, nodes binary, children binary, kind string"
NODE = np.dtype([("center", np.int32), ("lo", np.int32), ("hi", np.int32), ("first", np.int32), ("count", np.int32), ("label", np.int64), ("mixed", np.bool_), ("radius", np.float64)])


def quantised(vector: Column, factor: int = 256) -> Column:
    """Components times ``factor``, rounded down, as 64-bit integers; null where a component is null or not finite."""
    inf = F.lit(float("inf"))
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return F.when(vector.isNotNull() & ~F.coalesce(broken, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def _norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part."""
    named = need(rows, ["vec_id", "label", "vector"])
    named = named.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    named = named.where(~F.exists("vector", lambda x: x.isNull()) & (_norm(F.col("vector")) < LIMIT))
    return named.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<long>"))


def _narrow(points: np.ndarray) -> tuple[bytes, str]:
    """Bytes of integers in the smallest type that holds them."""
    most = int(np.abs(points).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return points.astype(kind).tobytes(), kind


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; ``points`` and ``query`` are both doubles or both integers."""
    return (points @ query).astype(np.int64)


def _working(points: np.ndarray) -> np.ndarray:
    """Doubles where no inner product of two such rows can pass 2^52, else the integers themselves."""
    x = points.astype(np.float64)
    return x if (x * x).sum(1).max(initial=0) < EXACT else points.astype(np.int64)


class Tree:
    """A cover tree over rows of ``points``; rows are kept in the order of the leaves, so that each node is a range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        x = points.astype(np.float64)
        square = (x * x).sum(1)
        self.top = float(square.max(initial=0))
        wide = np.concatenate([x, np.sqrt(np.maximum(self.top - square, 0))[:, None]], axis=1)
        full = (wide * wide).sum(1)
        order: list[np.ndarray] = []
        nodes: list[list] = []
        children: list[int] = []

        def far(rows: np.ndarray, center: int) -> np.ndarray:
            gap = full[rows] + full[center] - 2 * (wide[rows] @ wide[center])
            # Unequal whole numbers are 1 apart at least; less is rounding, which the bounds allow for.
            return np.sqrt(np.where(gap < max(0.5, 1e-13 * self.top), 0, gap))

        # A node's rows are cut into balls of half the radius, first come first served; the stack holds what is left to cut.
        start = np.arange(len(ids))
        stack = [(None, start, far(start, 0) if len(start) else np.zeros(0))]
        placed = 0
        while stack:
            parent, rows, away = stack.pop()
            radius = float(away.max(initial=0))
            mine = labels[rows]
            node = [int(rows[0]), placed, placed + len(rows), 0, 0, int(mine[0]), bool((mine != mine[0]).any()), radius]
            at = len(nodes)
            nodes.append(node)
            if parent is not None:
                children[parent] = at
            balls: list[tuple[np.ndarray, np.ndarray]] = []
            if len(rows) > LEAF and radius > 0:
                reach = radius / 2
                while len(balls) < 2:  # a radius at which all rows are in one ball is no level
                    balls, left = [], rows
                    while len(left):
                        d = far(left, int(left[0]))
                        d[0] = 0.0
                        near = d <= reach
                        balls.append((left[near], d[near]))
                        left = left[~near]
                    reach /= 2
            if not balls:
                order.append(rows)
                placed += len(rows)
                continue
            node[3], node[4] = len(children), len(balls)
            children.extend([0] * len(balls))
            # Pushed in reverse, so that leaves come in the order of the balls and each node stays a range.
            for k in range(len(balls) - 1, -1, -1):
                stack.append((node[3] + k, *balls[k]))
        perm = np.concatenate(order) if order else np.zeros(0, np.int64)
        where = np.empty(len(ids), np.int64)
        where[perm] = np.arange(len(ids))
        self.ids, self.labels, self.raw = ids[perm], labels[perm], points[perm]
        self.nodes = np.array([tuple(n) for n in nodes], NODE)
        if len(nodes):
            self.nodes["center"] = where[self.nodes["center"]]
        self.children = np.array(children, np.int32)

    def row(self, part: int, dim: int) -> tuple:
        blob, kind = _narrow(self.raw)
        return (part, dim, self.ids.tobytes(), self.labels.tobytes(), blob, self.nodes.tobytes(), self.children.tobytes(), kind)

    @classmethod
    def read(cls, row) -> Tree:
        self = cls.__new__(cls)
        self.ids, self.labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        self.raw = np.frombuffer(row.points, row.kind).reshape(len(self.ids), row.dim)
        self.nodes, self.children = np.frombuffer(row.nodes, NODE), np.frombuffer(row.children, np.int32)
        self.points = _working(self.raw)
        self.top = float((self.raw.astype(np.float64) ** 2).sum(1).max(initial=0))
        self.centers = self.points[self.nodes["center"]]
        return self

    def bounds(self, at: np.ndarray, query: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that the vectors of each node ``at`` can have with the query."""
        node = self.nodes[at]
        d = np.sqrt(np.maximum(square + self.top - 2 * (self.centers[at] @ query).astype(np.float64), 0))
        slack = 1e-6 * np.sqrt(square + self.top) + 1e-6
        near, far = np.maximum(d - node["radius"] - slack, 0), d + node["radius"] + slack
        spare = 1 + 1e-12 * (square + self.top)
        return (square + self.top - far * far) / 2 - spare, (square + self.top - near * near) / 2 + spare

    def descend(self, query: np.ndarray, wants, take) -> int:
        """Opens nodes, those with the highest bound first, while ``wants(low, high, nodes)`` marks any; ``take(ids, labels, scores)`` gets the rows of leaves.

        Returns the number of rows compared.
        """
        if self.points.dtype != np.float64 or float(query.astype(np.float64) @ query) >= EXACT:
            query, points = query.astype(np.int64), self.raw.astype(np.int64)
        else:
            query, points = query.astype(np.float64), self.points
        square, seen = float(query.astype(np.float64) @ query.astype(np.float64)), 0
        front = np.zeros(min(1, len(self.nodes)), np.int64)
        low, high = self.bounds(front, query.astype(self.centers.dtype), square)
        while len(front):
            keep = wants(low, high, self.nodes[front])
            front, low, high = front[keep], low[keep], high[keep]
            if not len(front):
                break
            first = np.argsort(-high, kind="stable")[:STEP] if len(front) > STEP else np.arange(len(front))
            now = front[first]
            rest = np.ones(len(front), bool)
            rest[first] = False
            count = self.nodes["count"][now]
            leaves = self.nodes[now[count == 0]]
            if len(leaves):
                rows = np.concatenate([np.arange(n["lo"], n["hi"]) for n in leaves])
                seen += len(rows)
                take(self.ids[rows], self.labels[rows], products(points[rows], query))
            inner = self.nodes[now[count > 0]]
            fresh = np.concatenate([self.children[n["first"] : n["first"] + n["count"]] for n in inner]).astype(np.int64) if len(inner) else np.zeros(0, np.int64)
            more = self.bounds(fresh, query.astype(self.centers.dtype), square)
            front = np.concatenate([front[rest], fresh])
            low, high = np.concatenate([low[rest], more[0]]), np.concatenate([high[rest], more[1]])
        return seen


class _Best:
    """The k best of what is offered: higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.ids) == self.k:
            ok = scores >= self.scores[-1]
            ids, scores = ids[ok], scores[ok]
        if len(ids):
            ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
            best = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[best], scores[best]

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.ids) == self.k else -np.inf


def _build(centers: dict[int, np.ndarray]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part, dim = int(key[0]), int(key[1])
        points = np.stack(pdf["vector"].to_numpy()).astype(np.int64)
        ids, labels = pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        if len(order) > TREE:  # rows near each other share a tree
            along = centers[dim][0] if dim in centers else np.ones(dim)
            order = order[np.argsort(points[order].astype(np.float64) @ along, kind="stable")]
        trees = [Tree(ids[x], labels[x], points[x]) for x in np.array_split(order, -(-len(order) // TREE))]
        return pd.DataFrame([t.row(part, dim) for t in trees], columns=["part", "dim", "ids", "labels", "points", "nodes", "children", "kind"])

    return run


def _centers(rows: DataFrame) -> dict[int, np.ndarray]:
    """Up to ``CELLS`` unit directions for each length of vectors: rows of the sample that are far from each other, chosen one by one."""
    out = {}
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r.vector), []).append(r.vector)
    for dim, vectors in by.items():
        x = np.array(vectors, np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(CELLS, len(x)) and near.min() < 0.999:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[dim] = x[chosen]
    return out


def _cells(centers: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = pdf["vector"].to_numpy()
            dims = np.array([len(v) for v in vectors], np.int32)
            cell = np.zeros(len(vectors), np.int32)
            for dim in np.unique(dims):
                if int(dim) in centers:
                    at = np.flatnonzero(dims == dim)
                    cell[at] = (np.stack(vectors[at]).astype(np.float64) @ centers[int(dim)].T).argmax(1)
            yield pdf.assign(dim=dims, cell=cell)

    return run


def build_index(rows: DataFrame) -> DataFrame:
    """Trees of all rows of ``rows(vec_id, label, vector)`` that take part, a row for each tree: ``part, dim, ...``."""
    rows = usable(rows)
    centers = _centers(rows)
    placed = materialize(rows.mapInPandas(_cells(centers), "vec_id long, label long, vector array<long>, dim int, cell int"), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    # As many rows as there are cells at most for each length of vectors.
    total = F.sum("n").over(Window.partitionBy("dim"))
    rows_each = F.least(F.greatest(F.ceil(total / PARTS), F.lit(TREE)), F.greatest(F.floor(F.lit(PART_NUMBERS) / F.col("dim")), F.lit(LEAF)))
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("n") / rows_each).cast("int")).select("dim", "cell", "parts"), "sizes")
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts").cast("long"))
    dealt = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("salt", salt)
    dealt = dealt.withColumn("part", F.xxhash64("dim", "cell", "salt")).drop("cell", "parts", "salt")
    return materialize(dealt.groupBy("part", "dim").applyInPandas(_build(centers), TREE_SCHEMA), "trees")


QUERY_SCHEMA = "dim int, ids binary, labels binary, points binary, kind string, marks binary"


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Queries as blocks; ``marks`` are the scores of an anchor's positives."""
    for pdf in batches:
        dims = pdf["vector"].map(len).to_numpy()
        for dim in np.unique(dims):
            own = pdf[dims == dim]
            step = max(1, BLOCK_BYTES // (8 * int(dim) + 64))
            for i in range(0, len(own), step):
                some = own.iloc[i : i + step]
                blob, kind = _narrow(np.stack(some["vector"].to_numpy()).astype(np.int64))
                marks = some["marks"].tolist()
                width = max(map(len, marks), default=0)
                grid = np.full((len(some), width + 1), 0, np.int64)
                for j, m in enumerate(marks):
                    grid[j, 0], grid[j, 1 : len(m) + 1] = len(m), m
                yield pd.DataFrame({"dim": [np.int32(dim)], "ids": [some["vec_id"].to_numpy(np.int64).tobytes()], "labels": [some["label"].to_numpy(np.int64).tobytes()], "points": [blob], "kind": [kind], "marks": [grid.tobytes()]})


def _positives(tree: Tree, i: int, label: int, query: np.ndarray, best: _Best) -> int:
    def wants(low, high, nodes):
        return (nodes["mixed"] | (nodes["label"] == label)) & (high >= best.least())

    def take(ids, labels, scores):
        ok = (labels == label) & (ids != i)
        best.offer(ids[ok], scores[ok])

    return tree.descend(query, wants, take)


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score with low * positive <= 100 * negative <= high * positive."""
    return -(-low * score // 100), high * score // 100


def _negatives(tree: Tree, i: int, label: int, query: np.ndarray, edges: list[tuple[int, int]], best: list[_Best]) -> int:
    def wants(low, high, nodes):
        open_ = np.zeros(len(nodes), bool)
        for (lo, hi), b in zip(edges, best, strict=True):
            open_ |= (low <= hi) & (high >= lo) & (high >= b.least())
        return open_ & (nodes["mixed"] | (nodes["label"] != label))

    def take(ids, labels, scores):
        other = (labels != label) & (ids != i)
        ids, scores = ids[other], scores[other]
        for (lo, hi), b in zip(edges, best, strict=True):
            ok = (scores >= lo) & (scores <= hi)
            b.offer(ids[ok], scores[ok])

    return tree.descend(query, wants, take)


FOUND = "anchor_id long, mark long, vec_id long, score long, compared long"


def _search(k: int, low: int | None, high: int | None):
    """Meets the trees of a part, which come first, with the query blocks that follow them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, trees = None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.part != part:
                    part, trees = row.part, []
                if row.role == 0:
                    trees.append(Tree.read(row))
                    continue
                ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
                points = np.frombuffer(row.points, row.kind).reshape(len(ids), row.dim)
                marks = np.frombuffer(row.marks, np.int64).reshape(len(ids), -1)
                out: list[list] = [[], [], [], [], []]
                for i, label, query, mark in zip(ids.tolist(), labels.tolist(), points, marks, strict=True):
                    if low is None:
                        found, seen = [(0, _Best(k))], 0
                        for t in trees:
                            seen += _positives(t, i, label, query, found[0][1])
                    else:
                        scores = sorted(set(mark[1 : mark[0] + 1].tolist()))
                        edges = [(s, window(s, low, high)) for s in scores]
                        edges = [(s, e) for s, e in edges if e[0] <= e[1]]
                        found, seen = [(s, _Best(k)) for s, _ in edges], 0
                        if edges:
                            for t in trees:
                                seen += _negatives(t, i, label, query, [e for _, e in edges], [b for _, b in found])
                    for s, b in found:
                        n = len(b.ids)
                        for column, values in zip(out, ([i] * n, [s] * n, b.ids.tolist(), b.scores.tolist(), [seen] * n), strict=True):
                            column.extend(values)
                yield pd.DataFrame(dict(zip(("anchor_id", "mark", "vec_id", "score", "compared"), (np.array(c, np.int64) for c in out), strict=True)))

    return run


def _meet(index: DataFrame, queries: DataFrame, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """What each part finds for each of ``queries(vec_id, label, vector, marks)``."""
    blocks = materialize(queries.mapInPandas(_pack, QUERY_SCHEMA), "queries")
    names = ["part", "role", "dim", "ids", "labels", "points", "nodes", "children", "kind", "marks"]
    none = F.lit(None).cast("binary")
    # Names of parts, eight bytes for thousands of vectors each, are dealt out to the blocks by a join on their length.
    parts = index.select("part", "dim").distinct()
    asked = blocks.join(parts, "dim").select("part", F.lit(1).alias("role"), "dim", "ids", "labels", "points", none.alias("nodes"), none.alias("children"), "kind", "marks")
    held = index.select("part", F.lit(0).alias("role"), "dim", "ids", "labels", "points", "nodes", "children", "kind", none.alias("marks")).select(*names)
    both = held.unionAll(asked).repartition("part").sortWithinPartitions("part", "role")
    return both.mapInPandas(_search(k, low, high), FOUND)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of ``anchors`` among ``rows``.

    Both tables have ``vec_id``, ``label`` and ``vector``, an array of whole numbers. A row's
    score is its inner product with the anchor; higher scores come first, ties by smaller
    vec_id. Positives are an anchor's first rows of its label, negatives of a positive are
    the first rows of other labels with low * positive <= 100 * negative <= high * positive,
    so a negative positive_score has none. Rows with a null id, label, vector or component,
    with an empty vector, or with a squared norm of 2^62 or more (scores would pass 64 bits)
    take no part; vectors of another length than the anchor's are no candidates; a row with
    the anchor's own id never serves it. Candidates that repeat count as often as they
    occur; of anchors that share an id the one with the smallest (label, vector) is taken.
    Further columns are ignored; empty tables give an empty result.
    """
    index = build_index(rows)
    asked = usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    asked = materialize(asked.select("vec_id", "row.label", "row.vector"), "anchors")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = _meet(index, asked.withColumn("marks", F.array().cast("array<long>")), positives)
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    held = materialize(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    marks = held.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("marks"))  # at most ``positives`` of them
    taken = _meet(index, asked.join(marks, "vec_id").select("vec_id", "label", "vector", "marks"), negatives, low, high)
    best = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "vec_id")
    taken = taken.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= negatives)
    taken = taken.select("anchor_id", F.col("mark").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return held.join(taken, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
