"""MinHash near-duplicates and hard negatives against brute force, and on odd, repeated and hot rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.llm import minhash, negatives
from gistmill.llm.ngram_join import shingle_set
from tests.llm.test_llm_operators import ODD, docs, empty


# 12
def pairs_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) >= 2 else ({tuple(words)} if words else set())


def brute(ids, texts):
    sets = [pairs_of(t) for t in texts]
    root = list(ids)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {(i, len(s), r, i == r) for i, s, r in zip(ids, sets, root, strict=True)}


def varied(rng, vocab, groups, copies):
    texts = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.randint(3, 120))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 7))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "  "]).join(words).title())
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_minhash_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [*ODD, *varied(rng, [f"w{i}" for i in range(400)], 25, 8), "one", "One", "two"]
    rng.shuffle(texts)
    ids = [7 * i - 300 for i in range(len(texts))]
    ids[5] = 2**53 + 1
    got = {tuple(r) for r in minhash.near_duplicates(docs(spark, texts, ids), long=20).collect()}
    assert got == brute(ids, texts)


def test_minhash_on_repeated_and_null_rows(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from it"
    rows = docs(spark, [long, long, long, long + " now", None, None, "other words here"], [None, 4, 4, 9, None, 3, None])
    got = sorted(map(tuple, minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 13, 4, False), (4, 13, 4, True), (4, 13, 4, True), (9, 14, 4, False), (None, 0, None, True), (3, 0, 3, True), (None, 2, None, True)], key=str)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_tables_combine_half_bands():
    one, other = shingle_set("a b c d e f g h i j k l m n o p", 2), shingle_set("a b c d e f g h i j k l m n o q", 2)
    a, b = minhash.sketch(one), minhash.sketch(other)
    half = (minhash.half_keys(a[None]) == minhash.half_keys(b[None]))[0]
    met = (minhash.table_keys(a[None]) == minhash.table_keys(b[None]))[0]
    assert len(met) == minhash.HALVES * (minhash.HALVES - 1) // 2
    assert [bool(half[i] and half[j]) for i, j in minhash.TABLES] == met.tolist()
    agree = (a == b).mean()
    exact = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
    assert abs(agree - exact) < 0.2


def test_hot_lists_stay_linear(spark):
    """A group of copies with small changes: candidate pairs are far fewer than all pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        texts.append(" ".join(words))
    near = minhash.Near(docs(spark, texts), long=50)
    found = near.run()
    assert found.select("component").distinct().count() == 1 and found.count() == 400
    assert near.links.count() < 400 * 60


def test_minhash_has_one_worker_a_task_and_small_batches(spark, monkeypatch):
    """No stage feeds one Python function from another, which would take two workers a task, and batches are small."""
    plans, rows, write, name = [], [], minhash.materialize, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def noted(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        rows.append(int(spark.conf.get(name)))
        return write(df, *a)

    monkeypatch.setattr(minhash, "materialize", noted)
    before = spark.conf.get(name)
    rng = random.Random(4)
    texts = varied(rng, [f"w{i}" for i in range(400)], 10, 6)
    assert {tuple(r) for r in minhash.near_duplicates(docs(spark, texts)).collect()} == brute(range(len(texts)), texts)
    assert spark.conf.get(name) == before and max(rows[:10]) <= 1000
    seen = 0
    for plan in plans:
        path = []  # of each node above: how far in it stands, and whether it is Python or an exchange
        for line in plan.splitlines():
            at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
            path = [x for x in path if x[0] < at]
            node = line[at:]
            if node.startswith(("MapInArrow", "MapInPandas")):
                above = [kind for _, kind in path if kind]
                assert above[-1:] != ["python"], plan
                path.append((at, "python"))
                seen += 1
            else:
                path.append((at, "exchange" if "Exchange" in node.split("(")[0].split(" ")[0] else ""))
    assert seen >= 5


# 13
def plain_negatives(rows, anchors, low=50, high=95, k=5, m=3):
    out = set()
    for i, label, q in anchors:
        score = [(-sum(a * b for a, b in zip(q, v, strict=True)), j, lab) for j, lab, v in rows if j != i and len(v) == len(q)]
        for p, j, _ in sorted(x for x in score if x[2] == label)[:k]:
            fits = sorted(x for x in score if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)[:m]
            out |= {(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fits)}
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise", "large"])
def test_negatives_match_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 90, (700, 6))
    if kind == "clusters":
        x = x[rng.integers(0, 30, 700)] + rng.integers(0, 3, (700, 6))
    if kind == "large":
        x = x * 2_000_003 + rng.integers(0, 1000, (700, 6))
    x[100:180] = x[100]  # ties
    rows = [(int(i) * 5 - 600 if i else 2**53 + 1, int(rng.integers(0, 4)), [int(v) for v in x[i]]) for i in range(700)]
    odd = [(None, 1, [1] * 6), (90_001, None, [1] * 6), (90_002, 1, None), (90_003, 1, []), (90_004, 1, [1, None, 1, 1, 1, 1]), (90_005, 1, [2**40] * 6)]
    short = [(91_000 + i, i % 2, [i, 7, 3]) for i in range(40)]
    df = spark.createDataFrame(rows + odd + short, "vec_id long, label int, vector array<long>").withColumn("score", F.lit("clash")).withColumn("part", F.lit(1))
    got = {tuple(r) for r in negatives.mine(df, df.where("vec_id % 50 = 0 OR vec_id > 90000")).collect()}
    want = plain_negatives(rows + short, [r for r in rows + short if r[0] % 50 == 0 or r[0] > 90000])
    assert got == want and len(want) > 100


def test_trees_cover_and_bound():
    rng = np.random.default_rng(1)
    points = rng.integers(-300, 300, (900, 5))
    points[50:400] = points[50]
    tree = negatives.Tree(np.arange(900), rng.integers(0, 3, 900), points)
    import pandas as pd

    row = next(pd.DataFrame([tree.row(1, 5)], columns=["part", "dim", "ids", "labels", "points", "nodes", "children", "kind"]).itertuples(index=False))
    tree = negatives.Tree.read(row)
    assert sorted(tree.ids.tolist()) == list(range(900)) and (points[tree.ids] == tree.raw).all()
    q = rng.integers(-200, 200, 5)
    low, high = tree.bounds(np.arange(len(tree.nodes)), q.astype(float), float(q @ q))
    for n, lo, hi in zip(tree.nodes, low, high, strict=True):
        inner = tree.raw[n["lo"] : n["hi"]].astype(np.int64) @ q
        assert lo <= inner.min() and inner.max() <= hi
    best = negatives._Best(5)
    seen = negatives._positives(tree, -1, 1, q, best)
    score = points @ q
    want = sorted((-s, i) for i, s in enumerate(score) if dict(zip(tree.ids.tolist(), tree.labels.tolist(), strict=True))[i] == 1)[:5]
    assert [(-s, i) for i, s in zip(best.ids.tolist(), best.scores.tolist(), strict=True)] == want and seen < 900


def test_negatives_on_nothing_and_repeats(spark):
    none = spark.createDataFrame([], "vec_id long, label int, vector array<long>")
    assert negatives.mine(none, none).count() == 0
    rows = [(0, 0, [10]), (0, 0, [10]), (1, 0, [10]), (2, 1, [9]), (2, 1, [9]), (3, 1, [2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    assert {tuple(r) for r in negatives.mine(df, df.where("vec_id = 0")).collect()} == {(0, 1, 1, 2, 100, 90), (0, 1, 2, 2, 100, 90)}


def test_quantised(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([None, 1.0],), ([float("nan")],), ([float("-inf")],), (None,)], "x array<float>")
    assert [r[0] for r in df.select(negatives.quantised(F.col("x"))).collect()] == [[128, -1], None, None, None, None]
