"""MinHash near-duplicates with tensored banding.

A set has ``HALVES`` half-bands of ``ROWS`` minimum hashes each, and a table for every pair
of half-bands (Andoni and Indyk's tensoring, public): 190 tables of six rows each need the
60 hashes of 20 half-bands, not 1,140. Two sets of similarity s agree in a half-band with
probability s^3 and meet in a table as soon as they agree in two of them; at s = 0.8 they
miss each other with probability 1.3e-5, at 0.85 with 5e-7.

1. One pass writes a row for each document: number of shingles, class (the set itself, so
   that copies are one class) and the minimum hashes. A class goes on once.
2. The keys of all tables are paired: each row of a list with the first and the previous
   one of its part of the list, and the first of the whole list; long lists are dealt out
   to parts by a salt. That is linear in the rows. Verified pairs give components. Classes
   of lists whose rows are still in two or more components are then compared wherever one
   of their rarest shingles is the same, which no linked pair can avoid. Pairs must fit in
   length and must agree in ``AGREE`` of the 60 hashes, which a pair at the threshold fails
   with probability 5e-8.
3. Pairs are made distinct and verified once on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import few_rows, materialize, need, sized_join, slices
from gistmill.llm.components import components
from gistmill.llm.ngram_join import DEN, NUM, _class_of, shingle_set, similar

SHINGLE = 2
#: Half-bands, hashes in each, and hashes that a pair has to agree in.
HALVES, ROWS, AGREE = 20, 3, 30
TABLES = list(combinations(range(HALVES), 2))
#: Rows of a list that one part or block of it holds, about.
LONG = 20_000
_SEEDS = np.random.default_rng(12).integers(1, 1 << 63, (HALVES * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(31)
#: Shingles that are hashed at a time.
RUN = 1 << 14


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The 60 minimum hashes of a set, 32 bits each."""
    least = np.full(len(_SEEDS), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(tokens), RUN):
        part = tokens[at : at + RUN]
        for j, (a, b) in enumerate(_SEEDS):
            h = (part ^ b) * a
            h ^= h >> _SHIFT
            least[j] = min(least[j], (h * b).min() >> np.uint64(32))
    return least.astype(np.uint32)


def half_keys(sketches: np.ndarray) -> np.ndarray:
    """64 bits for each half-band of each row of ``sketches``."""
    parts = sketches.reshape(len(sketches), HALVES, ROWS).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, HALVES + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def table_keys(sketches: np.ndarray) -> np.ndarray:
    """64 bits for each table, (rows, tables): the keys of two half-bands combined."""
    half = half_keys(sketches)
    left, right = (half[:, [t[i] for t in TABLES]] for i in (0, 1))
    key = (left ^ (right + np.uint64(0x9E3779B97F4A7C15) + (left << np.uint64(6)) + (left >> np.uint64(2)))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(t.as_py(), SHINGLE) for t in batch.column("text")]
        classes = [_class_of(s) if len(s) else None for s in sets]
        hashes = [sketch(s).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(classes, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "n", "cls", "sketch"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            sketches = np.frombuffer(b"".join(some.column("sketch").to_pylist()), np.uint32).reshape(some.num_rows, -1)
            keys = table_keys(sketches)
            where = np.repeat(np.arange(some.num_rows), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[some.column(c).take(pa.array(where)) for c in ("cls", "n")]], ["token", "cls", "n"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree often enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("a", "b"))
            ok = pa.array((a == b).sum(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], ["u", "v"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [s for t in batch.column("text") if len(s := shingle_set(t.as_py(), SHINGLE))]
        yield pa.RecordBatch.from_arrays([pa.array(map(_class_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "tokens"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_whole_sets`` gives, as lists that Spark can explode."""
    for batch in slices(batches):
        sets = [s for t in batch.column("text") if len(s := shingle_set(t.as_py(), SHINGLE))]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(map(_class_of, sets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cls", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("a", "b"))
        ok = pa.array(map(similar, a, b), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], ["u", "v"])


def _fits(n: Column, m: Column) -> Column:
    return F.least(n, m) * DEN >= F.greatest(n, m) * NUM


class Near:
    """Near-duplicates of one table; ``rows`` has a row for each row of it, ``links`` the verified pairs of classes."""

    def __init__(self, docs: DataFrame, long: int = LONG):
        self.long, self.docs = long, need(docs, ["doc_id", "text"])
        self.rows = materialize(self.docs.mapInArrow(_first_pass, "doc_id long, n long, cls long, sketch binary"), "sketches")
        one = self.rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.classes = materialize(one, "classes")

    def _postings(self) -> DataFrame:
        """Rows of lists that two or more classes have, with the previous row of their part, the first of it and the first of the list."""
        posts = self.classes.select("cls", "n", "sketch").mapInArrow(_keys, "token long, cls long, n long")
        order = Window.partitionBy("token").orderBy("n", "cls")
        posts = posts.withColumn("prev", F.lag("cls").over(order)).withColumn("next", F.lead("cls").over(order))
        posts = materialize(posts.where("prev IS NOT NULL OR next IS NOT NULL").select("token", "cls", "n"), "postings")
        # How long each list is, and for each class how many others its lists hold in all.
        sizes = materialize(posts.groupBy("token").agg(F.count("*").alias("size")), "sizes")
        met = materialize(posts.join(sizes, "token").groupBy("cls").agg(F.sum("size").alias("met")), "met")
        sizes = sizes.where(F.col("size") > self.long).select("token", F.ceil(F.col("size") / self.long).cast("int").alias("parts"))
        posts = sized_join(posts.join(met, "cls"), sizes, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        one = F.struct("cls", "n")
        # A text that others were made from meets more classes than they do; it comes first in the lists that it is in.
        order = Window.partitionBy("token", "salt").orderBy(F.desc("met"), "n", "cls")
        posts = posts.withColumn("salt", F.pmod("cls", "parts").cast("int"))
        posts = materialize(posts.withColumn("prev", F.lag(one).over(order)).withColumn("first", F.first(one).over(order)), "postings")
        head = posts.where("parts > 1").groupBy("token").agg(F.min_by(one, F.struct(-F.col("met"), "n", "cls")).alias("head"))
        return sized_join(posts, materialize(head, "heads"), "token", "left")

    def _sets(self, wanted: DataFrame, form=_whole_sets, kind: str = "binary") -> DataFrame:
        """``cls, tokens`` of the classes in ``wanted``, from a document of each, read again."""
        owner = materialize(self.classes.select("cls", "doc_id").join(wanted, "cls"), "owners")
        ids = owner.select(F.col("doc_id").alias("__d"))
        texts = sized_join(self.docs, ids, F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi")
        return sized_join(texts.select("text").mapInArrow(form, f"cls long, tokens {kind}"), owner.select("cls"), "cls", "left_semi")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(u, v)`` of classes that agree in their sketches and reach the threshold on their full sets."""
        sketches = self.classes.select("cls", "sketch")
        both = pairs.distinct().join(sketches.select(F.col("cls").alias("u"), F.col("sketch").alias("a")), "u")
        both = both.join(sketches.select(F.col("cls").alias("v"), F.col("sketch").alias("b")), "v").select("u", "v", "a", "b")
        pairs = materialize(both.mapInArrow(_agreeing, "u long, v long"), "pairs")
        # Rows that repeat a document repeat its set; the result is made distinct.
        sets = self._sets(pairs.select(F.col("u").alias("cls")).unionAll(pairs.select("v")).distinct())
        # Joins that shuffle: sets are made in one stage and compared in another, so that a task has one Python worker.
        both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("tokens").alias("a")).hint("merge"), "u")
        both = both.join(sets.select(F.col("cls").alias("v"), F.col("tokens").alias("b")).hint("merge"), "v")
        return materialize(both.mapInArrow(_verify, "u long, v long").distinct(), "links")

    def run(self) -> DataFrame:
        """``(cls, component)`` of every class that has a link; also keeps ``self.links``."""
        posts = self._postings()
        near = [posts.where(F.col(f"{x}.cls") != F.col("cls")).where(_fits(F.col(f"{x}.n"), F.col("n"))).select(F.least("cls", f"{x}.cls").alias("u"), F.greatest("cls", f"{x}.cls").alias("v")) for x in ("prev", "first", "head")]
        tried = materialize(near[0].unionAll(near[1]).unionAll(near[2]).distinct(), "tried")
        links = self._verified(tried)
        found = materialize(components(links), "components")
        rest = materialize(self._apart(posts.select("token", "cls", "n"), found).join(tried, ["u", "v"], "left_anti"), "rest")
        more = self._verified(rest)
        self.links = links.unionAll(more)
        return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more))

    def _apart(self, posts: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs of classes from lists whose rows are in two or more components, each pair once.

        Most of these lists come of one text that all their rows were made from and are too
        far from each other. So the rows of such lists are met by the shingles that at least
        one of any two linked sets must share: each set's rarest, in a number that the
        threshold gives. Long lists of those are dealt out to blocks on both sides, so that
        no task meets more than two blocks of one.
        """
        named = posts.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        mixed = materialize(named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "tokens")
        some = materialize(named.join(mixed, "token").select("cls", "n", "component").distinct(), "mixed")
        tokens = self._sets(some.select("cls"), _whole_lists, "array<long>").dropDuplicates(["cls"])
        tokens = materialize(tokens.select("cls", F.explode("tokens").alias("token")), "shingles")
        often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
        shared = materialize(tokens.join(often, "token"), "shared")
        # Shingles of a single class come first and meet nothing; what is left of the prefix is taken from the shared ones.
        own = shared.groupBy("cls").agg(F.count("*").alias("shared")).join(some, "cls").withColumn("own", F.col("n") - F.col("shared"))
        place = F.row_number().over(Window.partitionBy("cls").orderBy("often", "token")) - 1
        prefix = shared.withColumn("place", place).join(materialize(own, "own"), "cls").withColumn("pos", F.col("own") + F.col("place"))
        prefix = prefix.where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1).select("token", "often", "cls", "n", "component", "pos")
        prefix = prefix.withColumn("blocks", F.ceil(F.col("often") / 1000).cast("int")).drop("often").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
        prefix = materialize(prefix, "prefixes")
        left = prefix.select("token", "cls", "n", "component", "pos", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
        right = prefix.select("token", *[F.col(c).alias(f"other_{c}") for c in ("cls", "n", "component", "pos")], F.col("block").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
        n, m = F.col("n"), F.col("other_n")
        reach = F.least(n - F.col("pos"), m - F.col("other_pos")) * (NUM + DEN) >= (n + m) * NUM  # shingles from this one on must suffice
        met = left.join(right, ["token", "x", "y"]).where((F.col("cls") < F.col("other_cls")) & (F.col("component") != F.col("other_component")) & _fits(n, m) & reach)
        return met.select(F.col("cls").alias("u"), F.col("other_cls").alias("v")).distinct()


def near_duplicates(docs: DataFrame, long: int = LONG) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id, kept``, a row for each input row.

    Two documents link when 100 * intersection >= 80 * union of their sets of two-word
    shingles (A-Z lower-cased, words split at ASCII white space), confirmed on the full
    sets. ``component_id`` is the smallest doc_id reachable by links, and ``kept`` marks the
    rows that have it. Null and empty texts have no shingle, link with nothing and are kept;
    a text of one word is one shingle. Rows with a null doc_id take part, get the smallest
    doc_id of their component that is not null, and are kept only if there is none. Repeated
    rows each get a row. Further columns are ignored; an empty table gives an empty result.
    Lists of more than about ``long`` rows are dealt out to several tasks, which changes no
    result.
    """
    with few_rows(docs.sparkSession):
        near = Near(docs, long)
        found = materialize(near.run().withColumnRenamed("node", "cls"), "classes")
    # One row for each class; only components of more than one document need a smallest id looked up.
    least = near.rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("lead"), F.count("*").alias("k"))
    named = least.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    best = materialize(named.groupBy("component").agg(F.min("lead").alias("component_id"), F.sum("k").alias("k")).where("k > 1").drop("k"), "least")
    moved = materialize(sized_join(named, best, "component", "inner").select("cls", "component_id"), "moved")
    worded = sized_join(near.rows.where("cls IS NOT NULL").select("doc_id", "n", "cls"), moved, "cls", "left")
    out = worded.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.unionAll(near.rows.where("cls IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
