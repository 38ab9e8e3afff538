"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Method (public: PPJoin+, Xiao et al. 2008), laid out as Spark jobs:

1. One pass hashes every document's 5-word shingles to 64 bits and writes
   ``(doc_id, key, n, class)``, where a class is the set of shingles itself: copies fall
   into one class and only one of them goes on; ``key`` is the text's MD5. The same pass
   counts, over all documents, the shingles that recur, in a table of fixed size (2**20
   buckets). Those that occur once in a run of documents are not added to it: they would
   drown the others.
2. A second pass orders each class's shingles rare first (bucket count, then hash) and
   explodes its prefix of floor(n/5)+1 shingles. Any two sets with a Jaccard similarity of
   0.8 or more share a shingle of their prefixes, whatever the order, so the bucketed
   counts affect cost alone, never the result.
3. Postings that share a shingle are paired. First each posting is paired only with the
   first and the previous one of its list, in the order of how few shingles a class has
   to itself (linear in the list); the links found give components. Lists that the counts
   show to be long are dealt out to several tasks by a salt, each part's postings also
   being paired with the first of the whole list. Then every pair that is still in two
   components is formed and tested, so no component is split while groups of near copies
   stay linear.
4. Pairs pass the length and positional filters inside the join, are made distinct, and
   are verified once, after a suffix filter, on the whole sets.

``links`` holds the verified links that give the components, not all links inside a
component: pairs whose ends are already together are never formed.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import few_rows, materialize, need, sized_join, slices, unwrap, wrapped
from gistmill.llm.components import components

SHINGLE = 5
#: Similarity as a fraction of whole numbers, so that the test is exact: inter/union >= 80/100.
NUM, DEN = 80, 100
BUCKETS = 1 << 20
#: Shingles that the first pass looks at together for those that recur.
RUN = 1 << 22
#: Postings that a part of a long list holds, about.
LONG = 100_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; shorter texts are one shingle; no word, no shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    acc = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        acc = (acc ^ h[j : len(h) - width + 1 + j]) * _MIX[0]
        acc ^= acc >> np.uint64(29)
        acc *= _MIX[1]
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def _class_of(tokens: np.ndarray) -> int:
    """64 bits that stand for the whole set; null stands for the empty set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


class _Recurring:
    """Bucket counts of the shingles that recur within a run of documents."""

    def __init__(self):
        self.counts, self.held, self.buffer = np.zeros(BUCKETS, np.uint32), 0, None

    def add(self, tokens: np.ndarray) -> None:
        if self.buffer is None:
            self.buffer = np.empty(RUN, np.uint64)
        for at in range(0, len(tokens), RUN):
            part = tokens[at : at + RUN]
            if self.held + len(part) > RUN:
                self.flush()
            self.buffer[self.held : self.held + len(part)] = part
            self.held += len(part)

    def flush(self) -> None:
        if self.held:
            own = self.buffer[: self.held]
            own.sort()
            again = own[1:] == own[:-1]
            first = again.copy()
            first[1:] &= ~again[:-1]
            for one in (again, first):  # marks, not places: a run of shingles that differ is held once
                np.add.at(self.counts, (own[:-1][one] % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
            self.held = 0


INFO = "doc_id long, key binary, n long, cls long, counts binary"


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, names = _Recurring(), ["doc_id", "key", "n", "cls", "counts"]
    for batch in slices(batches):
        sizes, classes = [], []
        for text in batch.column("text"):
            tokens = shingle_set(text.as_py())
            seen.add(tokens)
            sizes.append(len(tokens))
            classes.append(_class_of(tokens) if len(tokens) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(len(sizes), pa.binary())], names)
    seen.flush()
    if seen.counts.any():
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([zlib.compress(seen.counts.tobytes(), 1)], pa.binary())], names)


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.uint32)
    for pdf in batches:
        for x in pdf["counts"]:
            fresh = np.frombuffer(zlib.decompress(x), np.uint32)
            total = np.where(total > ~fresh, np.uint32(0xFFFFFFFF), total + fresh)  # stays at the top
    if total.any():
        yield pd.DataFrame({"counts": [zlib.compress(total.tobytes(), 1)]})


def _bucket_counts(info: DataFrame) -> np.ndarray:
    """Sums of the per-task tables, in three levels so that no task adds up more than a share of them."""
    got = info.where("n = -1").select("counts").mapInPandas(_add_up, "counts binary").repartition(64)
    got = got.mapInPandas(_add_up, "counts binary").repartition(1).mapInPandas(_add_up, "counts binary").first()
    return np.frombuffer(zlib.decompress(got[0]), np.uint32) if got else np.zeros(BUCKETS, np.uint32)


def _prefixes(counts: np.ndarray, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, classes, sizes, prefix, parts = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                if len(s := shingle_set(text.as_py())):
                    often = counts[(s % np.uint64(BUCKETS)).astype(np.int64)]
                    order = np.lexsort((s, often))[: len(s) - math.ceil(len(s) * NUM / DEN) + 1]
                    at.append(i)
                    classes.append(_class_of(s))
                    sizes.append(len(s))
                    prefix.append(s[order].view(np.int64))
                    parts.append((often[order] // long + 1).astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, kind))) for x, kind in ((prefix, np.int64), (parts, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), *lists], ["doc_id", "cls", "n", "prefix", "parts"])

    return run


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [s for t in batch.column("text") if len(s := shingle_set(t.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array(map(_class_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "tokens"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted sets, after a suffix filter that compares how the sets spread over pivots."""
    least = -(-NUM * (len(a) + len(b)) // (NUM + DEN))  # overlap that the threshold asks for
    cuts = np.searchsorted(b, a[[len(a) // 4, len(a) // 2, 3 * len(a) // 4]])
    parts_a = np.diff([0, len(a) // 4, len(a) // 2, 3 * len(a) // 4, len(a)])
    if np.minimum(parts_a, np.diff([0, *cuts, len(b)])).sum() < least:
        return False
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * inter >= NUM * (len(a) + len(b) - inter)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["a"], pdf["b"], strict=True)]
        yield pdf.loc[ok, ["u", "v"]]


def _fits(other: str) -> F.Column:
    """Length filter, and positional filter for a common shingle at place ``pos`` (from 0) of ``n``.

    The filter holds at the first common shingle of every pair that reaches the threshold:
    the two have nothing in common before it. A pair need not pass at its later ones.
    """
    n, m = F.col("n").cast("long"), F.col(f"{other}n").cast("long")
    most = F.least(n - F.col("pos"), m - F.col(f"{other}pos"))
    return (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (most * (NUM + DEN) >= (n + m) * NUM)


class NgramJoin:
    """The join over one table; ``links`` and ``classes`` are tables in the shared folder."""

    def __init__(self, docs: DataFrame, long: int = LONG):
        self.long = long
        self.docs = need(docs, ["doc_id", "text"])
        keyed = self.docs.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        self.info = materialize(keyed.mapInArrow(_first_pass, INFO), "shingles")
        self.counts = _bucket_counts(self.info)
        self.rows = self.info.where("n >= 0").select("doc_id", "key", "n", "cls")

    def _copies(self) -> DataFrame:
        """Documents whose class another one stands for."""
        lead = materialize(self.rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("lead"), F.count("*").alias("k")).where("k > 1"), "leaders")
        return materialize(self.rows.join(lead, "cls").where(~F.col("doc_id").eqNullSafe(F.col("lead"))).select("doc_id", "cls").distinct(), "copies")

    def _postings(self, copies: DataFrame) -> DataFrame:
        """Prefix shingles that two or more classes have, with the previous posting of their part of a list, and the first of the part and of the list."""
        sets = self.docs.mapInArrow(_prefixes(self.counts, self.long), "doc_id long, cls long, n int, prefix array<long>, parts array<int>")
        sets = sized_join(sets, copies.select(F.col("doc_id").alias("__d"), F.col("cls").alias("__c")), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("cls") == F.col("__c")), "left_anti")
        posts = sets.select("cls", "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x")).select("cls", "n", "pos", F.col("x.prefix").alias("token"), F.col("x.parts").alias("parts"))
        posts = posts.withColumn("salt", F.pmod("cls", "parts").cast("int"))
        # The window only marks shingles that a single class has; most have no partner. Long lists stay whole.
        order = Window.partitionBy("token", "salt").orderBy("n", "cls")
        posts = posts.withColumn("prev", F.lag("cls").over(order)).withColumn("next", F.lead("cls").over(order))
        posts = materialize(posts.where("prev IS NOT NULL OR next IS NOT NULL OR parts > 1").drop("prev", "next"), "postings")
        posts = posts.withColumn("own", F.floor(F.col("n") * (DEN - NUM) / DEN) + 1 - F.count("*").over(Window.partitionBy("cls")))
        # A text that others were made from shares most of its prefix; what is changed in a copy is rare and its own.
        order = Window.partitionBy("token", "salt").orderBy("own", "n", "cls")
        one = F.struct("cls", "n", "pos")
        posts = materialize(posts.withColumn("prev", F.lag(one).over(order)).withColumn("first", F.first(one).over(order)), "postings")
        head = posts.where("parts > 1").groupBy("token").agg(F.min_by(one, F.struct("own", "n", "cls")).alias("head"))
        return sized_join(posts.drop("own", "salt"), materialize(head, "heads"), "token", "left").drop("parts")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(u, v)`` of classes that reach the threshold."""
        pairs = materialize(pairs.distinct(), "pairs")
        wanted = materialize(pairs.select(F.col("u").alias("cls")).unionAll(pairs.select("v")).distinct(), "wanted")
        owner = self.rows.join(wanted, "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        ids = owner.select(F.col("doc_id").alias("__d"))
        texts = sized_join(self.docs, ids, F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
        # Rows that repeat a document would repeat its set; the result is made distinct, so they do no harm.
        sets = sized_join(texts.select("text").mapInArrow(_whole_sets, "cls long, tokens binary"), wanted, "cls", "left_semi")
        both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("tokens").alias("a")), "u")
        both = both.join(sets.select(F.col("cls").alias("v"), F.col("tokens").alias("b")), "v")
        return materialize(both.mapInPandas(_verify, "u long, v long").distinct(), "links")

    def run(self) -> DataFrame:
        """``(cls, component)`` of every class that has a link; also keeps ``self.links``."""
        posts = self._postings(self._copies())
        near = [posts.where(F.col(f"{x}.cls") != F.col("cls")).where(_fits(f"{x}.")).select(F.least("cls", f"{x}.cls").alias("u"), F.greatest("cls", f"{x}.cls").alias("v")) for x in ("prev", "first", "head")]
        tried = materialize(near[0].unionAll(near[1]).unionAll(near[2]).distinct(), "tried")
        links = self._verified(tried)
        found = materialize(components(links), "components")
        # Every pair whose classes are not together yet.
        posts = posts.select("token", "cls", "n", "pos")
        named = posts.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        mixed = materialize(named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "tokens")
        named = materialize(named.join(mixed, "token"), "mixed")
        left, right = named, named.select("token", *[F.col(c).alias(f"other_{c}") for c in ("cls", "n", "pos", "component")])
        rest = left.join(right, "token").where((F.col("cls") < F.col("other_cls")) & (F.col("component") != F.col("other_component")) & _fits("other_")).select(F.col("cls").alias("u"), F.col("other_cls").alias("v"))
        rest = rest.distinct().join(tried, ["u", "v"], "left_anti")
        more = self._verified(rest)
        self.links = links.unionAll(more)
        self.candidates = (tried, rest)
        return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more))


def _grouped(docs: DataFrame, long: int = LONG) -> DataFrame:
    """``doc_id, key, n, component`` of every row; null without shingles. Rows of texts without words never meet a join."""
    with few_rows(docs.sparkSession):
        join = NgramJoin(docs, long)
        found = materialize(join.run().withColumnRenamed("node", "cls"), "classes")
    worded = sized_join(join.rows.where("cls IS NOT NULL"), found, "cls", "left").select("doc_id", "key", "n", F.coalesce("component", "cls").alias("component"))
    return worded.unionAll(join.rows.where("cls IS NULL").select("doc_id", "key", "n", F.lit(None).cast("long")))


def jaccard_components(docs: DataFrame, long: int = LONG) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id``, one row per input row.

    Two documents link when 100 * intersection >= 80 * union of their 5-word shingle sets
    (A-Z lower-cased, words split at ASCII white space). ``component_id`` is the smallest
    doc_id reachable by links. Null and empty texts have no shingle, link with nothing and
    keep their own doc_id; rows with a null doc_id take part and get the smallest non-null
    doc_id of their component, if any. Repeated rows each get their row. Further columns
    are ignored; an empty table gives an empty result. Lists of more than about ``long``
    postings are dealt out to several tasks, which changes no result.
    """
    rows = materialize(_grouped(docs, long), "rows")
    worded = rows.where("component IS NOT NULL")
    # Only components of more than one document need a smallest id looked up.
    least = materialize(worded.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k"), "least")
    out = sized_join(worded, least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionAll(rows.where("component IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each component: the one with the smallest doc_id.

    Null doc_ids come last, and among equal ids the text with the smaller MD5 stays, so a
    doc_id that two unlike texts share loses neither. Of rows that repeat the document
    that stays (same id, same text) one stays; which one is not defined where their
    further columns differ. Texts without words, null ones too, are no copies and all
    stay. An empty table gives an empty result; columns may have any names.
    """
    rows = materialize(_grouped(docs).where("component IS NOT NULL").groupBy("component", "doc_id", "key").agg(F.count("*").alias("k")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    best = materialize(rows.groupBy("component").agg(first.alias("best"), F.sum("k").alias("rows")).where("rows > 1").drop("rows"), "best")
    met = sized_join(rows, best, "component", "inner")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    met = materialize(met.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), kept.alias("kept"), (F.col("k") > 1).alias("again")), "met")
    named = docs.select(wrapped(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k"))
    left = sized_join(named, met.where("NOT kept").select("__d", "__k"), same, "left_anti")
    again = met.where("kept AND again").select("__d", "__k")
    once = sized_join(left, again, same, "left_anti").select("row")
    one = sized_join(left, again, same, "left_semi").groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row")
    return unwrap(once.unionAll(one), "row", docs.columns)
