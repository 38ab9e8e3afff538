"""Alignment of two tokenizers against a plain walk over their tokens, and the perfect hash."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gistmill.llm import align
from gistmill.llm.perfect_hash import PerfectHash
from tests.llm.test_llm_operators import LONG, docs, empty

FIRST, SECOND = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "   \n\t", "a", "A b C d", "x" * 3000, LONG[:20_000], "ÄÖ ünï — 中文 🙂 é", "a\x1cb　c d\xa0e f", "two  spaces   and\n\nlines \n end ", " lead", "trail ", "\ttab", "a \n b",
    "<|endoftext|> and <s> or <unk> <0x41>", "under▁score stays out", "▁", "nul\0 here", "the cat's whiskers' end", "The quick brown fox jumps", "The quick brown fox jumps", "https://example.org/a?b=c&d=1 is 12,345.67", "é combining", "ﬁ ligature Å", "  odd   spaces here",
]


def plain(texts):
    """Rows without doc_id, by walking along both token lists."""
    a, b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    own = align.Tokenizers(FIRST, SECOND)
    walked, df = [], collections.Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        if not text or any(b"".join(own.bytes[s][i] for i in ids[s]) != raw for s in (0, 1)):
            walked.append(([], [], [], None))
            continue
        ends = [np.cumsum([len(own.bytes[s][i]) for i in ids[s]]).tolist() for s in (0, 1)]
        i = j = 0
        links, groups, now = [], [], [[ids[0][0]], [ids[1][0]]]
        while True:
            links.append((ids[0][i], ids[1][j]))
            x, y = ends[0][i], ends[1][j]
            if x == y:
                groups.append("|".join(",".join(map(str, side)) for side in now))
                now = [[], []]
            if x == y == len(raw):
                break
            if x <= y:
                i += 1
                now[0].append(ids[0][i])
            if y <= x:
                j += 1
                now[1].append(ids[1][j])
        df.update(set(links))
        walked.append((*ids, links, groups))
    top = collections.Counter()
    for (x, _), n in df.items():
        top[x] = max(top[x], n)
    return [(len(x), len(y), len(g or []), len(k), sum(df[p] == top[p[0]] for p in k), sum(df[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for x, y, k, g in walked]


@pytest.mark.parametrize("options", [{}, {"shard": 16, "table_bytes": 0}])
def test_alignment_matches_a_plain_walk(spark, options):
    ids = [None, 2**53 + 1, *range(len(TEXTS) - 2)]
    got = align.align(docs(spark, TEXTS, ids=ids), FIRST, SECOND, **options).collect()
    want = [(i, *row) for i, row in zip(ids, plain(TEXTS), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.n_a > 0 for r in got) >= len(TEXTS) - 6
    assert align.align(empty(spark), FIRST, SECOND, **options).count() == 0


def test_units_stand_alone():
    own = align.Tokenizers(FIRST, SECOND)
    assert own.alone
    for text in TEXTS:
        if text:
            assert " ".join(own.units(text)) == text
            whole = own._both(text)
            if own._right(whole, text):
                assert all((x == y).all() for x, y in zip(own.read([text])[0], whole, strict=True))


@pytest.mark.parametrize("n", [0, 1, 2, 70, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False) - (1 << 39)
    made = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(made.index(keys).tolist()) == list(range(n))
    other = made.index(np.arange(1 << 41, (1 << 41) + 500))
    assert ((other >= -1) & (other < max(n, 1))).all()
    assert len(made.bits) <= 8 + n  # less than a byte for each key


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5]))


@pytest.mark.parametrize("options", [{}, {"shard": 16, "table_bytes": 0}])
def test_texts_are_read_once(spark, options):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = [t for t in TEXTS if t] * 3
    rows = docs(spark, texts).mapInArrow(counted, "doc_id long, text string")
    got = align.align(rows, FIRST, SECOND, **options).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(plain(texts))
    assert read.value == len(texts)  # tokenizing costs nearly all of the time, and was done in both passes


def test_distinct_units_are_aligned_once(monkeypatch):
    own = align.Tokenizers(FIRST, SECOND)
    monkeypatch.setattr(align, "CHUNK", 3)
    texts = [t or "" for t in TEXTS] + ["again again the  end again", "again end\n", "the end"]
    units, codes, sizes = own.cut(pa.array([*texts, None]))
    assert len(set(units)) == len(units) == codes.max() + 1
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    assert [[units[i] for i in p] for p in parts] == [own.units(t) if t else [] for t in texts] + [[]]
    got = align.Documents(own, pa.array([*texts, None]))
    want = plain([*texts, None])
    assert [tuple(r) for r in zip(got.n_a, got.n_b, got.n_groups, got.n_links, got.digests, strict=True)] == [(*r[:4], r[6]) for r in want]
    for none in ([], [None, ""]):
        assert align.Documents(own, pa.array(none, pa.string())).digests == [""] * len(none)


def test_pairs_are_counted_and_packed():
    number = np.array([3, 1, 3, 0, 2, 2, 2])
    for numbers in (4, 4_000):  # by cells, by sorting
        at, found, times = align._often(np.array([0, 3, 3, 7]), number, numbers)
        assert (at.tolist(), found.tolist(), times.tolist()) == ([0, 2, 2, 4], [1, 3, 0, 2], [1, 2, 1, 3])
    keys = np.array([5 << 32 | 7, 65_535 << 32 | 65_535, 0])
    for narrow, more in ((True, []), (False, [70_000 << 32 | 80_000])):
        wide = np.append(keys, np.array(more, np.int64))
        assert align._unpacked(align._packed(wide, narrow).tobytes(), len(wide)).tolist() == wide.tolist()
