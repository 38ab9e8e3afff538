"""Byte-level BPE encoding and decoding.

Two forms of one encoder, both a fold of ranked merges over the bytes of distinct words:

* ``encode_words`` folds with Spark's higher-order functions over the byte arrays of a table
  of distinct words; the rank map is a literal row, split by hash into an array of small
  maps because a lookup in one Spark map compares every key.
* ``encode_documents`` folds in the tasks that read the documents, each distinct word once
  a task, and shuffles nothing. The query uses it: mapping words back to their places by
  joins moves more than the texts themselves (figures in the README).
"""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions.exprs import let
from gistmill.llm.common import need, slices

#: Words in each of the two generations that a task remembers, and those of a slice; it forgets the older one when the younger is full, which changes no result.
MEMO = 60_000
#: Words that are merged together, about, and the rank of parts that make no piece.
ROWS, NONE = 4_000, np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, whose lines hold a base64 piece and its rank; a vocabulary, of fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: the pair with the lowest rank is merged, leftmost first, until none has a rank.

    Long words (over 64 pieces) keep their pairs in a heap, so that a very long run of one
    kind of character takes n log n steps.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    import heapq

    n = len(word)
    piece: list = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] is not None else n
        if j >= n or len(piece[i]) + len(piece[j]) != size:
            continue  # one of the two has been merged meanwhile
        piece[i], piece[j] = piece[i] + piece[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0 and right < n and (r := ranks.get(both := piece[left] + piece[right])) is not None:
                heapq.heappush(heap, (r, left, len(both)))
    return [ranks[p] for p in piece if p is not None]


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which two parts make a piece: sorted keys (left << 32 | right), the rank of each, and the part that stands for each byte.

    A part is a piece, by its rank, or a byte that is no piece, by a number after the ranks.
    """
    top = max(ranks.values(), default=-1) + 1
    single = [ranks.get(bytes([b]), top + b) for b in range(256)]
    part = ranks | {bytes([b]): x for b, x in enumerate(single)}
    found = [(x << 32 | y, r) for piece, r in ranks.items() for i in range(1, len(piece)) if (x := part.get(piece[:i])) is not None and (y := part.get(piece[i:])) is not None]
    keys, values = np.array(found, np.int64).reshape(-1, 2).T
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.int32), np.array(single, np.int32)


def merge_words(words: list[bytes], pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """Token ids, 32 bits each, of each word of at most 64 bytes, as ``merge`` gives them, but for words that are a piece: all words take each step together, a row of a matrix each."""
    keys, values, single = pairs

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(left.shape, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        return np.where(keys[at] == key, values[at], NONE)

    first = rank(np.repeat(single, 256), np.tile(single, 256))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = [b""] * len(words)
    low = 0
    for high in (6, 8, 10, 12, 16, 24, 64):  # rows of about one length together
        for some in np.array_split(where := np.flatnonzero((sizes > low) & (sizes <= high)), len(where) // ROWS + 1):
            if not len(some):
                continue
            n, k = sizes[some], np.arange(high)
            raw = np.frombuffer(b"".join([words[i].ljust(high, b"\0") for i in some]), np.uint8).reshape(-1, high)
            # A column more on the right, of what is no part and no pair, is what moves in from there.
            parts = np.zeros((len(some), high + 1), np.int32)
            parts[:, :-1] = single[raw]
            ranks = np.full((len(some), high + 1), NONE, np.int32)
            ranks[:, : high - 1] = first[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
            ranks[:, :-1][k >= n[:, None] - 1] = NONE
            while True:
                rows = np.arange(len(some))
                at = ranks.argmin(1)  # the leftmost of the lowest
                best = ranks[rows, at]
                if (done := best == NONE).any():
                    flat = parts[done].tobytes()
                    for i, place, m in zip(range(0, len(flat), 4 * high + 4), some[done].tolist(), (4 * n[done]).tolist(), strict=True):
                        out[place] = flat[i : i + m]
                    left = ~done
                    some, n, parts, ranks, at, best, rows = some[left], n[left], parts[left], ranks[left], at[left], best[left], rows[: left.sum()]
                if not len(some):
                    break
                n -= 1
                moved = k > at[:, None]
                parts[:, :-1] = np.where(moved, parts[:, 1:], parts[:, :-1])
                parts[rows, at] = best
                ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
                ranks[rows, at] = np.where(at + 1 < n, rank(best, parts[rows, at + 1]), NONE)
                before = np.flatnonzero(at)
                ranks[before, at[before] - 1] = rank(parts[before, at[before] - 1], best[before])
        low = high
    return out


def _encode(ranks: dict[bytes, int], pattern: str):
    """Function from texts to an array of ids for each that merges each distinct word once while it is remembered.

    The fresh words of all the texts are merged together; the ids of a word are kept as bytes.
    """
    pairs = pair_ranks(ranks)
    state: dict = {}

    def learn(words: set[str]) -> None:
        young, old = state["young"], state["old"]
        fresh = []
        for word in words.difference(young):
            if (got := old.get(word)) is None and (whole := ranks.get(raw := word.encode())) is not None:
                got = whole.to_bytes(4, sys.byteorder)
            elif got is None and len(raw) > 64:
                got = np.array(merge(raw, ranks), np.int32).tobytes()
            if got is None:
                fresh.append(word)
            else:
                young[word] = got
        young.update(zip(fresh, merge_words([w.encode() for w in fresh], pairs), strict=True))

    def run(texts: Iterable[str | None]) -> list[np.ndarray]:
        if not state:  # made in the task, not sent to it
            whole = regex.compile(pattern)
            state.update(find=(lambda text: [m[0] for m in whole.finditer(text)]) if whole.groups else whole.findall, young={}, old={})
        words = [state["find"](text or "") for text in texts]
        learn(set().union(*words))
        get = state["young"].__getitem__
        ids = [np.frombuffer(b"".join(map(get, own)), np.int32) for own in words]
        if partial and any((x > top).any() for x in ids):
            raise KeyError("a byte that is no piece is left over")
        if len(state["young"]) >= MEMO:
            state["old"], state["young"] = state["young"], {}
        return ids

    top = max(ranks.values(), default=-1)
    partial = (pairs[2] > top).any()  # some byte is no piece
    return run


def encode_rows(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs(text, ...)``, then ``n_tokens`` and ``ids``. Nothing is shuffled.

    Null and empty texts have no ids; repeated rows each give a row; columns that are not in
    ``keep`` are not read; an empty table gives an empty result.
    """
    run = _encode(ranks, pattern)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = run(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.diff(offsets).astype(np.int64)), ids], [*keep, "n_tokens", "ids"])

    names = list(dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return need(docs, names).mapInArrow(each, schema)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` for every row of ``docs(doc_id, text)``; null and empty texts have no ids."""
    return encode_rows(docs, ranks, pattern, ["doc_id"])


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids, decoded``: the binary pieces of ``tokens(doc_id, ids)`` set together, by a literal array of pieces."""
    pieces = _pieces(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(decoded=[b"".join([pieces[i] for i in ids]) for ids in pdf["ids"]])

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encodes and decodes every row in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Each match of ``pattern`` is encoded separately, without special tokens. Null texts
    count as empty; repeated rows each give a row; an empty table gives an empty result.
    """
    pieces = _pieces(ranks)
    names = [str(i) for i in range(len(pieces))]
    encode = _encode(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, ids, decoded = [], [], []
            for row in encode(batch.column("text").to_pylist()):
                row = row.tolist()
                counts.append(len(row))
                ids.append(hashlib.sha256(",".join([names[i] for i in row]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([pieces[i] for i in row])).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return need(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rank_table(spark: SparkSession, ranks: dict[bytes, int], buckets: int) -> DataFrame:
    """One row: the ranks as an array of small maps, by hash of the piece; as large as the vocabulary, which is fixed."""
    parts: list[list] = [[] for _ in range(buckets)]
    for piece, rank in ranks.items():
        parts[zlib.crc32(piece) % buckets].append((bytearray(piece), rank))
    return spark.createDataFrame([(parts,)], "ranks array<array<struct<piece:binary,rank:int>>>").select(F.lit(1).alias("__k"), F.transform("ranks", lambda x: F.map_from_entries(x)).alias("__ranks"))


def encode_words(words: DataFrame, ranks: dict[bytes, int], buckets: int = 16384) -> DataFrame:
    """``word, ids`` for a table of distinct words, by higher-order functions alone.

    A word that is a piece itself is looked up at once. Else a fold over its bytes merges, in
    each step, the leftmost pair with the lowest rank; the ranks of all neighbouring pairs
    are carried along, so that a step looks up two pairs at most.
    """
    none = 2**31 - 1

    def rank(piece: Column) -> Column:
        slot = F.element_at(F.col("__ranks"), (F.crc32(piece) % buckets + 1).cast("int"))
        return F.coalesce(F.try_element_at(slot, piece), F.lit(none))

    def step(acc: Column, _: Column) -> Column:
        def merged(v: Column) -> Column:
            parts, old, at, both = v["parts"], v["ranks"], v["at"], v["both"]
            one = F.array(both)
            left = F.when(at > 1, F.array(rank(F.concat(F.get(parts, at - 2), both)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < F.size(parts), F.array(rank(F.concat(both, F.get(parts, at + 1))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(parts, 1, at - 1), one, F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                F.concat(F.slice(old, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(old, at + 2, F.size(parts))).alias("ranks"),
            )

        def at(best: Column) -> Column:
            place = F.array_position(acc["ranks"], best).cast("int")
            found = let(place, lambda i: F.struct(acc["parts"].alias("parts"), acc["ranks"].alias("ranks"), i.alias("at"), F.concat(F.get(acc["parts"], i - 1), F.get(acc["parts"], i)).alias("both")))
            return F.when(best < none, let(found, merged)).otherwise(acc)

        return let(F.coalesce(F.array_min(acc["ranks"]), F.lit(none)), at)

    raw = F.col("__word")
    size = F.octet_length(raw)
    rows = words.select(F.lit(1).alias("__k"), "word", F.encode("word", "UTF-8").alias("__word")).join(F.broadcast(_rank_table(words.sparkSession, ranks, buckets)), "__k")
    pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(raw, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank(F.substring(raw, i, F.lit(2))))
    fold = F.aggregate(F.sequence(F.lit(2), size), F.struct(pieces.alias("parts"), pairs.alias("ranks")), step)["parts"]
    whole = let(rank(raw), lambda r: F.when(r < none, F.array(r)))
    ids = F.when(size == 0, F.array().cast("array<int>")).otherwise(F.coalesce(whole, F.when(size > 1, F.transform(fold, rank))))
    return rows.select("word", ids.alias("ids"))
