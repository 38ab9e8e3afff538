"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often a pair does.

Two tokenizers read the same bytes, a space and the text. Their tokens' ends cut these into
pieces; each piece lies in one token of either, and is one link. Where both end a token, a
group ends.

1. The documents are read and aligned once. What the counts do not touch is finished there
   and written, each document beside its distinct pairs and how often it has each; the pass
   also gives, for each run of documents, the linked pairs of ids and the number of its
   documents that hold each.
2. The distinct pairs are dealt out to shards by hash, and each shard gets a minimal perfect
   hash of its pairs, which stay beside it. A run's counts become dense vectors indexed by
   that hash, which are summed as a tree: first within the ``FAN`` branches of a shard, then
   across them.
3. The pairs written with the documents are looked up; the key that is kept under an index
   tells whether it is the pair asked for. The finished shards are read by every task if
   they have at most ``TABLE_BYTES`` together. Beyond that, the pairs of documents go to the
   shards: the same lookups, behind a shuffle.

Both tokenizers work on units, runs between two single spaces, alone: neither has a piece
that crosses from another character into a space. So each task tokenizes a unit once while
it remembers it, and aligns the distinct units of some texts, of which each text's links and
groups are set together.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import materialize, need, slices
from gistmill.llm.perfect_hash import PerfectHash, mixed

#: Units in each of the two generations that a process remembers.
MEMO = 400_000
#: Stands for the ids of a unit that a tokenizer does not give back.
WRONG = b""
#: Pair occurrences counted together, pairs of a shard about, branches of a sum, bytes of the table that tasks read whole.
RUN, SHARD, FAN, TABLE_BYTES = 1 << 22, 1 << 16, 8, 96 << 20
#: Bytes of texts aligned together, units tokenized in one go (longer strings cost more a unit), cells of documents and pairs counted together.
TOGETHER, CHUNK, CELLS = 2 << 20, 1_000, 1 << 20
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_TWO = re.compile(r"\s\s")


@lru_cache(maxsize=4)
def _byte_values() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """A: byte-level BPE of a ``tokenizers`` JSON file, reading a space and the text; B: a ``sentencepiece`` model, reading the text.

    Special tokens are never made: their strings inside a text are plain text.
    """

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        values = _byte_values()
        words = json.loads(self.a.to_str())["model"]["vocab"]
        bytes_a: list[bytes] = [b""] * (max([*words.values(), self.a.get_vocab_size() - 1]) + 1)
        for word, i in words.items():
            bytes_a[i] = bytes(values[c] for c in word) if all(c in values for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = (bytes_a, bytes_b)
        self.sizes = tuple(np.array(list(map(len, x)), np.int64) for x in self.bytes)
        self.narrow = max(map(len, self.bytes)) <= 1 << 16
        # No piece may cross from another character into a space, or units would not stand alone.
        self.alone = not any(re.search(r"\S ", x.decode("utf-8", "replace")) for x in (*bytes_a, *bytes_b))
        # One string of bytes a unit, as few objects are quicker to find again: the number of its ids of A, these, and its ids of B.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _both(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int32), np.array(self.b.encode(text), np.int32)

    def _right(self, ids: tuple[np.ndarray, np.ndarray], text: str) -> bool:
        raw = (" " + text).encode()
        return all(b"".join(map(names.__getitem__, x.tolist())) == raw for names, x in zip(self.bytes, ids, strict=True))

    def units(self, text: str) -> list[str]:
        """Cuts at single spaces between other characters."""
        return _BORDER.split(text) if self.alone else [text]

    def cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of some texts, the units of all texts as numbers of these, and how many each text has; none where a text is null or empty."""
        lists = pc.split_pattern(texts, " ")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        units, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        # A cut at every space is right unless a piece is empty or begins or ends with white space.
        if self.alone and not _TWO.search(f" {' '.join(units)} "):
            return units, codes, sizes
        outer = np.array([not u or u[0].isspace() or u[-1].isspace() or not self.alone for u in units], bool)
        odd = np.unique(np.repeat(np.arange(len(sizes)), sizes)[outer[codes]])
        if not len(odd):
            return units, codes, sizes
        number = {u: i for i, u in enumerate(units)}
        parts = np.split(codes, np.cumsum(sizes)[:-1])
        for i, text in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist(), strict=True):
            parts[i] = np.array([number.setdefault(u, len(number)) for u in self.units(text)] if text else [], np.int64)
        used, codes = np.unique(np.concatenate(parts), return_inverse=True)
        units = list(number)
        return [units[i] for i in used.tolist()], codes, np.array(list(map(len, parts)), np.int64)

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of units, ``WRONG`` for units whose bytes they do not give back. Units that begin and end with other characters are read in one go."""
        plain = [u for u in fresh if u and not u[0].isspace() and not u[-1].isspace()]
        out: dict[str, bytes] = {}
        for start in range(0, len(plain), CHUNK):
            part = plain[start : start + CHUNK]
            joined = " ".join(part)
            ids = self._both(joined)
            if self._right(ids, joined):
                ends = np.cumsum([len(u.encode()) + 1 for u in part])
                cuts = [np.searchsorted(np.cumsum(size[x]), ends, "left") + 1 for size, x in zip(self.sizes, ids, strict=True)]
                n_a = np.diff(cuts[0], prepend=0).astype(np.int32)
                flat = np.insert(ids[1], np.repeat(np.append(0, cuts[1][:-1]), n_a), ids[0])
                first = cuts[0] - n_a + np.append(0, cuts[1][:-1])
                raw = np.insert(flat, first, n_a).tobytes()
                last = ((cuts[0] + cuts[1] + np.arange(1, len(part) + 1)) * 4).tolist()
                out.update((u, raw[i:j]) for u, i, j in zip(part, [0, *last[:-1]], last, strict=True))
        for u in fresh:
            if u not in out:
                ids = self._both(u)
                out[u] = np.concatenate([[len(ids[0])], *ids]).astype(np.int32).tobytes() if self._right(ids, u) else WRONG
        return out

    def known(self, units: list[str]) -> list[bytes]:
        """Ids of A and B of distinct units, after the number of those of A; ``WRONG`` where a tokenizer does not give the bytes back."""
        got = list(map(self.young.get, units))
        if None in got:
            fresh = [u for u, g in zip(units, got, strict=True) if g is None]
            again = {u: g for u in fresh if (g := self.old.get(u)) is not None}
            self.young.update(again)
            self.young.update(self._learn([u for u in fresh if u not in again]))
            got = list(map(self.young.get, units))
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        return got

    def read(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none where a text is null or empty, or a tokenizer does not give its bytes back."""
        units, codes, sizes = self.cut(pa.array(texts, pa.string()))
        known, out = self.known(units), []
        for part in np.split(codes, np.cumsum(sizes)[:-1]):
            got = [np.frombuffer(known[i], np.int32) for i in part.tolist()]
            got = [] if any(not len(g) for g in got) else [(g[1 : 1 + g[0]], g[1 + g[0] :]) for g in got]
            out.append(tuple(np.concatenate([np.zeros(0, np.int32), *[g[side] for g in got]]) for side in (0, 1)))
        return out


_READY: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(first: str, second: str) -> Tokenizers:
    """One for each process, which later tasks find again."""
    if (first, second) not in _READY:
        _READY.clear()
        _READY[first, second] = Tokenizers(first, second)
    return _READY[first, second]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    values = np.sort(values, kind="stable")  # a radix or merge sort, fast on runs
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Aligned:
    """Links of distinct units: ``unit`` and ``key``, the ids of A and B, of every link, in order, and the tokens themselves. ``wrong`` units have none."""

    def __init__(self, own: Tokenizers, units: list[str]):
        read = own.known(units)
        size = np.fromiter(map(len, read), np.int64, len(read)) // 4
        self.wrong = size == 0
        flat, head = np.frombuffer(b"".join(read), np.int32), (np.cumsum(size) - size)[~self.wrong]
        n_a = np.zeros(len(read), np.int64)
        n_a[~self.wrong] = flat[head]
        self.n = [n_a, size - n_a - ~self.wrong]
        side = np.repeat(np.tile([2, 0, 1], len(read)), np.stack([~self.wrong, *self.n], axis=1).ravel())
        self.ids = [flat[side == k] for k in (0, 1)]
        ends = [np.cumsum(own.sizes[side][self.ids[side]]) for side in (0, 1)]
        # Both sides cover the same bytes of each unit, so ends stay comparable over all of them.
        cuts = _distinct(np.concatenate(ends))
        at = [np.searchsorted(e, cuts, "left") for e in ends]
        a, b = (x[i].astype(np.int64) for x, i in zip(self.ids, at, strict=True))
        self.unit = np.repeat(np.arange(len(units)), self.n[0])[at[0]]
        self.key = a << 32 | b
        # A token ends a group if the other side has the same end.
        both = np.diff(np.append(at[0], len(ends[0]))) + np.diff(np.append(at[1], len(ends[1]))) == 2 if len(cuts) else np.zeros(0, bool)
        self.closes = [np.zeros(len(e), bool) for e in ends]
        for closed, i in zip(self.closes, at, strict=True):
            closed[i[both]] = True

    def written(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups of each unit and their text, ``a1,a2|b1;a3|b2,b3;``."""
        units = len(self.n[0])
        groups = np.bincount(np.repeat(np.arange(units), self.n[0])[self.closes[0]], minlength=units)
        # Places of all tokens in the order in which they are written: by group, A before B.
        group = np.concatenate([np.cumsum(c) - c for c in self.closes])
        side = np.repeat([0, 1], [len(x) for x in self.ids])
        order = np.argsort(group * 2 + side, kind="stable")
        marks = np.where(np.concatenate(self.closes), side + 1, 0)[order]
        shown = _written()[marks, np.concatenate(self.ids)[order]].view(np.uint8).reshape(len(order), _written().itemsize)
        sizes = np.concatenate([[0], np.cumsum(np.count_nonzero(shown, axis=1))])
        text = shown[shown != 0].tobytes()
        cuts = sizes[np.concatenate([[0], np.cumsum(self.n[0] + self.n[1])])].tolist()
        return groups, [text[i:j] for i, j in pairwise(cuts)]


def _sums(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Exact sums of whole numbers between cuts that follow each other."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])


def _often(cuts: np.ndarray, number: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of each document, in order, and how often it has each: places where documents begin and end, numbers, times."""
    docs = len(cuts) - 1
    doc = np.repeat(np.arange(docs), np.diff(cuts))
    if docs * numbers <= 16 * len(number):  # few enough cells to count all of them
        step, cells, times = max(1, CELLS // numbers) if numbers else 1, [], []
        for first in range(0, docs, step):
            part = slice(cuts[first], cuts[min(first + step, docs)])
            counted = np.bincount((doc[part] - first) * numbers + number[part], minlength=1)
            some = np.flatnonzero(counted)
            cells.append(some + first * numbers)
            times.append(counted[some])
        cell, often = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (cells, times))
    else:
        cell, often = np.unique(doc * numbers + number, return_counts=True)
    return np.searchsorted(cell, np.arange(docs + 1) * numbers), cell % max(numbers, 1), often


class Documents:
    """Tokens, groups and pairs of some texts; ``pairs`` are sorted keys, ``number`` the distinct ones of each text from ``at`` to the next, ``often`` how often it has each."""

    def __init__(self, own: Tokenizers, texts: pa.Array):
        units, codes, sizes = own.cut(texts)
        got = Aligned(own, units)
        docs = len(sizes)
        doc = np.repeat(np.arange(docs), sizes)
        if got.wrong.any():
            wrong = np.bincount(doc, got.wrong[codes], docs) > 0
            codes, doc = codes[~wrong[doc]], doc[~wrong[doc]]
        cuts = np.searchsorted(doc, np.arange(docs + 1))
        groups, written = got.written()
        links = np.bincount(got.unit, minlength=len(units))
        each = links[codes]
        self.n_a, self.n_b, self.n_groups, self.n_links = (_sums(cuts, x) for x in (got.n[0][codes], got.n[1][codes], groups[codes], each))
        shown = [written[i] for i in codes.tolist()]
        # Without the last mark.
        self.digests = [hashlib.sha256(b"".join(shown[i:j])[:-1]).hexdigest() if i < j else "" for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        self.pairs, number = np.unique(got.key, return_inverse=True)
        before = np.cumsum(links) - links
        of_unit = np.repeat(before[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        self.at, self.number, self.often = _often(np.concatenate([[0], np.cumsum(self.n_links)]), number[of_unit], len(self.pairs))


def _packed(keys: np.ndarray, narrow: bool) -> np.ndarray:
    """Ids of both sides in four bytes where both vocabularies have at most 2^16 pieces."""
    return (keys >> 16 | keys & 0xFFFF).astype(np.uint32) if narrow else keys


def _unpacked(data: bytes, n: int) -> np.ndarray:
    """Keys from what ``_packed`` made of ``n`` of them."""
    if len(data) != 4 * n:
        return np.frombuffer(data, np.int64)
    keys = np.frombuffer(data, np.uint32).astype(np.int64)
    return keys >> 16 << 32 | keys & 0xFFFF


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` cut at places."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


@lru_cache(maxsize=1)
def _written() -> np.ndarray:
    """Decimal ids with the mark after them: a comma, a bar after the last A of a group, a semicolon after the last B."""
    names = np.arange(1 << 17).astype("S6")
    return np.stack([np.char.add(names, mark) for mark in (b",", b"|", b";")])


FACTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
READ = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, often binary, keys binary, counts binary"


def _first_pass(first: str, second: str):
    """A row for each document, with its ``pairs`` and how ``often`` it has each, and one for each run of them, with ``keys`` and ``counts``."""
    schema = pa.schema([*((c, pa.string() if c == "groups_sha256" else pa.int64()) for c in FACTS), *((c, pa.binary()) for c in ("pairs", "often", "keys", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            keys, number = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, number, np.concatenate([c for _, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in schema.types[:-2]], *[pa.array([x.tobytes()], pa.binary()) for x in (keys, counts)]], schema=schema)

        own = _tokenizers(first, second)
        for batch in slices(batches, TOGETHER):
            got = Documents(own, batch.column("text"))
            counts = np.bincount(got.number, minlength=len(got.pairs))
            some = counts > 0  # pairs of texts that have no tokens as a whole are held by none
            if some.any():
                held.append((got.pairs[some], counts[some]))
                size += int(some.sum())
            facts = [batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)], pa.array(got.digests, pa.string())]
            pairs = [_blobs(_packed(got.pairs[got.number], own.narrow), got.at), _blobs(got.often.astype(np.int32), got.at)]
            yield pa.RecordBatch.from_arrays([*facts, *pairs, *[pa.nulls(batch.num_rows, pa.binary())] * 2], schema=schema)
            if size >= RUN:
                yield row()
                size = 0
        if held:
            yield row()

    return run


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 10_007) % np.uint64(shards)).astype(np.int32)


def _by_shard(shards: int):
    """Partial counts cut up by shard: ``shard, branch, keys, counts``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, counts in zip(pdf["keys"], pdf["counts"], strict=True):
                k, c = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                shard = _shard_of(k, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                own = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
                branch = int(mixed(k[:1], 5)[0] + np.uint64(len(k))) % FAN
                yield pd.DataFrame({"shard": np.array(own, np.int32), "branch": np.full(len(own), branch, np.int32), "keys": [k[order[cuts[i] : cuts[i + 1]]].tobytes() for i in own], "counts": [c[order[cuts[i] : cuts[i + 1]]].tobytes() for i in own]})

    return run


def _united(level: str):
    """Distinct keys of the rows of a group that follow each other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, keys = None, np.zeros(0, np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                group = (row.shard, row.branch) if level == "branch" else (row.shard, 0)
                if now is not None and group != now:
                    yield pd.DataFrame({"shard": [np.int32(now[0])], "branch": [np.int32(now[1])], "keys": [keys.tobytes()]})
                    keys = np.zeros(0, np.int64)
                now, keys = group, np.union1d(keys, np.frombuffer(row.keys, np.int64))
        if now is not None:
            yield pd.DataFrame({"shard": [np.int32(now[0])], "branch": [np.int32(now[1])], "keys": [keys.tobytes()]})

    return run


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The perfect hash of each shard, and its keys in the order of their indexes."""
    for pdf in batches:
        hashes, ordered = [], []
        for blob in pdf["keys"]:
            keys = np.frombuffer(blob, np.int64)
            own = PerfectHash.build(keys)
            kept = np.empty(len(keys), np.int64)
            kept[own.index(keys)] = keys
            hashes.append(own.to_bytes())
            ordered.append(kept.tobytes())
        yield pd.DataFrame({"shard": pdf["shard"].astype(np.int32), "hash": hashes, "table": ordered})


def _dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dense vectors of counts: rows of one shard and branch follow each other and are added up as they come."""
    now, own, total = None, None, np.zeros(0, np.int64)
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if (row.shard, row.branch) != now:
                if now is not None:
                    yield pd.DataFrame({"shard": [np.int32(now[0])], "vector": [total.tobytes()]})
                now, own, total = (row.shard, row.branch), PerfectHash.from_bytes(row.hash), np.zeros(len(row.table) // 8, np.int64)
            total[own.index(np.frombuffer(row.keys, np.int64))] += np.frombuffer(row.counts, np.int64)
    if now is not None:
        yield pd.DataFrame({"shard": [np.int32(now[0])], "vector": [total.tobytes()]})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the vectors of a shard, which follow each other."""
    now, total = None, np.zeros(0, np.int64)
    for pdf in batches:
        for shard, blob in zip(pdf["shard"].tolist(), pdf["vector"], strict=True):
            vector = np.frombuffer(blob, np.int64)
            if shard != now:
                if now is not None:
                    yield pd.DataFrame({"shard": [np.int32(now)], "vector": [total.tobytes()]})
                now, total = shard, vector.copy()
            else:
                total += vector
    if now is not None:
        yield pd.DataFrame({"shard": [np.int32(now)], "vector": [total.tobytes()]})


def _best_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The highest count of each id of A in a shard."""
    for pdf in batches:
        for table, vector in zip(pdf["table"], pdf["vector"], strict=True):
            a, count = np.frombuffer(table, np.int64) >> 32, np.frombuffer(vector, np.int64)
            order = np.lexsort((count, a))
            last = np.append(a[order][1:] != a[order][:-1], True) if len(a) else np.zeros(0, bool)
            yield pd.DataFrame({"a": a[order][last], "top": count[order][last]})


class PairCounts:
    """Counts of all linked pairs of runs of documents: ``shards``, a row for each of them."""

    def __init__(self, runs: DataFrame, shard: int = SHARD):
        # From above: the distinct pairs are at most all pairs of the runs, and a shard holds the more of them the fewer recur.
        size = runs.agg(F.sum(F.octet_length("keys") / 8).alias("all"), F.max(F.octet_length("keys") / 8).alias("most")).first()
        self.count = max(1, -(-int(min(size["all"] or 0, 4 * (size["most"] or 0))) // shard))
        parts = materialize(runs.mapInPandas(_by_shard(self.count), "shard int, branch int, keys binary, counts binary"), "parts")
        keys = parts.select("shard", "branch", "keys").repartition("shard", "branch").sortWithinPartitions("shard", "branch")
        keys = keys.mapInPandas(_united("branch"), "shard int, branch int, keys binary")
        keys = keys.repartition("shard").sortWithinPartitions("shard").mapInPandas(_united("shard"), "shard int, branch int, keys binary")
        hashes = materialize(keys.mapInPandas(_hashed, "shard int, hash binary, table binary"), "hashes")
        fan = hashes.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
        met = parts.join(fan, ["shard", "branch"]).sortWithinPartitions("shard", "branch").select("shard", "branch", "hash", "table", "keys", "counts")
        dense = met.mapInPandas(_dense, "shard int, vector binary")
        dense = dense.repartition("shard").sortWithinPartitions("shard").mapInPandas(_summed, "shard int, vector binary")
        counted = materialize(hashes.join(dense, "shard"), "counted")
        # A row for each id of A, whose number the vocabulary bounds.
        tops = counted.select("table", "vector").mapInPandas(_best_rows, "a long, top long").groupBy("a").agg(F.max("top").alias("top")).toPandas()
        tops = dict(zip(tops["a"].tolist(), tops["top"].tolist(), strict=True))
        self.top = np.zeros(max(tops, default=-1) + 1, np.int64)
        self.top[list(tops)] = list(tops.values())
        self.shards = counted

    def size(self) -> int:
        row = self.shards.agg(F.sum(F.octet_length("hash") * 10 + F.octet_length("table") + F.octet_length("vector"))).first()
        return int(row[0] or 0)


class _Table:
    """Lookup of counts in the finished shards."""

    def __init__(self, rows, count: int, top: np.ndarray):
        self.count, self.top = count, top
        self.shards = {r.shard: (PerfectHash.from_bytes(bytes(r.hash)), np.frombuffer(r.table, np.int64), np.frombuffer(r.vector, np.int64)) for r in rows}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """How many documents hold each pair; 0 for a pair that none has."""
        out = np.zeros(len(keys), np.int64)
        shard = _shard_of(keys, self.count)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.count + 1))
        for i, (own, table, vector) in self.shards.items():
            at = order[cuts[i] : cuts[i + 1]]
            if len(at):
                index = own.index(keys[at])
                known = (index >= 0) & (table[index] == keys[at])  # the kept key verifies the hash
                out[at[known]] = vector[index[known]]
        return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _second_pass(table):
    made: list[_Table] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(_Table(*table.value))
        counts = made[0]
        for batch in slices(batches, TOGETHER, "pairs"):
            often = [x.as_py() for x in batch.column("often")]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in often])])
            often = np.frombuffer(b"".join(often), np.int32).astype(np.int64)
            keys, number = np.unique(_unpacked(b"".join(x.as_py() for x in batch.column("pairs")), len(often)), return_inverse=True)
            found = counts.counts(keys)
            best = found == counts.top[keys >> 32] if len(keys) else found > 0
            columns = {c: batch.column(c) for c in FACTS} | {"n_best": pa.array(_sums(at, often * best[number])), "count_sum": pa.array(_sums(at, often * found[number]))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in COLUMNS], COLUMNS)

    return run


def _asking(shards: int):
    """Each document, and for each shard the pairs it asks for: ``row, shard, keys, often`` with the document's own columns in the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER, "pairs"):
            columns: list[list] = [[] for _ in range(11)]
            for doc in batch.to_pylist():
                often = np.frombuffer(doc["often"], np.int32).astype(np.int64)
                keys = _unpacked(doc["pairs"], len(often))
                shard = _shard_of(keys, shards)
                for s in np.unique(shard).tolist():
                    at = shard == s
                    for c, v in zip(columns, [doc["row"], s, keys[at].tobytes(), often[at].tobytes(), None, 0, 0, 0, 0, None, 1], strict=True):
                        c.append(v)
                for c, v in zip(columns, [doc["row"], -1, None, None, *[doc[x] for x in FACTS], 0], strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "shard", "keys", "often", *FACTS, "asks"])

    return run


ASKED = "row long, shard int, keys binary, often binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, asks int"


def _answers(count: int, top: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, table = None, None
        for pdf in batches:
            best, total = [], []
            for row in pdf.itertuples(index=False):
                if row.shard != now:
                    now, table = row.shard, _Table([row], count, top)
                keys, often = np.frombuffer(row.keys, np.int64), np.frombuffer(row.often, np.int64)
                found = table.counts(keys)
                best.append(int(often[found == top[keys >> 32]].sum()))
                total.append(int((often * found).sum()))
            yield pd.DataFrame({"row": pdf["row"].to_numpy(np.int64), "n_best": np.array(best, np.int64), "count_sum": np.array(total, np.int64)})

    return run


def align(docs: DataFrame, first: str, second: str, shard: int = SHARD, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Alignment of two tokenizers on ``docs(doc_id, text)``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row for each input row.

    ``first`` is a byte-level BPE file of ``tokenizers``, ``second`` a ``sentencepiece``
    model; their paths have to hold wherever tasks run. A link's count is the number of rows
    that hold its pair of ids linked; ``n_best`` counts the links whose count is the highest
    of their id of A, ties included. Null and empty texts, and texts whose bytes a tokenizer
    does not give back, have no tokens: zeros, and '' for the digest. Rows that repeat count
    as often as they occur, also in the counts; null doc_ids take part. Further columns are
    ignored; an empty table gives an empty result. ``shard`` and ``table_bytes`` change cost
    alone.
    """
    spark = docs.sparkSession
    read = materialize(need(docs, ["doc_id", "text"]).mapInArrow(_first_pass(first, second), READ), "aligned")
    counts = PairCounts(read.where("keys IS NOT NULL").select("keys", "counts"), shard)
    rows = read.where("keys IS NULL").select(*FACTS, "pairs", "often")
    if counts.size() <= table_bytes:
        table = spark.sparkContext.broadcast((counts.shards.collect(), counts.count, counts.top))
        return rows.mapInArrow(_second_pass(table), OUT)
    asked = materialize(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_asking(counts.count), ASKED), "asked")
    keys = asked.where("asks = 1").select("row", "shard", "keys", "often").join(counts.shards, "shard").sortWithinPartitions("shard")
    sums = keys.mapInPandas(_answers(counts.count, counts.top), "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = asked.where("asks = 0").drop("keys", "often", "shard").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select(*COLUMNS)
