"""Similar titles by blocks against every pair compared."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from gistmill.operators import dedup


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_lengths_over_words():
    rng = random.Random(3)
    others = sorted(("".join(rng.choices("abc知é", k=rng.randint(1, 200))) for _ in range(30)), key=lambda t: -len(t))
    letters = sorted(set("".join(others)))
    columns = np.zeros((len(others[0]), len(others)), np.int32)
    for i, t in enumerate(others):
        columns[: len(t), i] = [letters.index(c) for c in t]
    live = np.array([sum(len(t) > j for t in others) for j in range(len(others[0]))])
    for n in (1, 63, 64, 65, 128, 150):
        one = "".join(rng.choices("abcxyz知", k=n))
        pattern = np.array([letters.index(c) if c in letters else -1 for c in one])
        assert dedup.common_lengths(pattern, columns, live, len(letters)).tolist() == [_common(one, t) for t in others]


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_of_blocks_are_all_pairs(spark, block):
    rng = random.Random(block)
    base = ["".join(rng.choices("abcde fg知", k=rng.randint(3, 90))) for _ in range(9)]
    titles = sorted({"".join(c if rng.random() > 0.12 else rng.choice("abxé") for c in rng.choice(base)) for _ in range(90)} - {""})
    rows = [(t, rng.choice([1.0, 2.0, None, float("nan")]), i) for i, t in enumerate(titles)]
    kind = lambda s: 0 if s is None else 2 if s != s else 1
    rank = lambda r: (kind(r[1]), r[1] if kind(r[1]) == 1 else 0, r[2])
    want = {(a[2], b[2]) for a in rows for b in rows if rank(a) > rank(b) and SequenceMatcher(None, a[0], b[0]).ratio() >= 0.75}
    got = dedup.similar_titles(spark.createDataFrame(rows, "clean string, s double, q long"), 0.75, block).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want != set()


def _pairs(ones, others, same=False):
    return {(i, k) for i, a in enumerate(ones) for k, b in enumerate(others) if (not same or i < k) and 2 * _common(a, b) >= 0.75 * (len(a) + len(b))}


def test_few_pairs_are_compared_in_order(monkeypatch):
    rng = random.Random(5)
    sounds = [["the", "ion ", "er", "an", "wh", "ly", "ou ", "bl"], ["ción", "ñe ", "lla", "ga ", "que", "do", "bo "], ["ung", "schä", "ver ", "ich ", "tz", "pf"]]
    heads = ["云计算降价谁在受益", "人形机器人开放公测", "万字报告深度学习", "效率工具笔记教程", ""]
    titles = [rng.choice(heads) + "".join(rng.choices(s, k=24))[:60] for s in sounds for _ in range(80)]
    titles += [t[:30] + "x" + t[31:] for t in titles[:20]]
    met, real = [], dedup.common_lengths
    monkeypatch.setattr(dedup, "common_lengths", lambda patterns, columns, live, *rest: met.append(int(live[0])) or real(patterns, columns, live, *rest))
    got = list(dedup._near(titles, titles, 0.75, True))
    want = _pairs(titles, titles, True)
    assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want and len(want) >= 20
    assert sum(met) < 0.3 * len(titles) * (len(titles) - 1) / 2


def test_near_over_many_characters_repeats_and_lengths(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(dedup, "CELLS", 900)  # several products of matrices, and several runs of pairs
    monkeypatch.setattr(dedup, "PAIRS", 50)
    letters = [chr(0x4E00 + i) for i in range(400)] + ["🤖"]  # more than stand alone
    base = ["".join(rng.choices(letters, k=n)) for n in (5, 40, 70, 130)] + ["a" * 40, "a" * 55 + "b" * 3, "ab" * 70, "é", "x" * 64, "x" * 65]
    titles = sorted({"".join(c if rng.random() > 0.1 else rng.choice("ax") for c in rng.choice(base)) for _ in range(110)})
    assert set(dedup._near(titles[::2], titles[1::2], 0.75, False)) == _pairs(titles[::2], titles[1::2])
    got = list(dedup._near(titles, titles, 0.75, True))
    assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == _pairs(titles, titles, True)
