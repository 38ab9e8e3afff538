"""Each training-data operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gistmill.llm import ann, bpe, components, fixity, media, mixing, ngram_join, pii, preference, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, key string, spans string"
LONG = "word " * 30_000
ODD = [None, "", "   \n\t", "a", "A b C d", "x" * 70_000, LONG, "ÄÖ ünï — 中文 🙂 é", "a\x1cb　c"]


def docs(spark, texts, ids=None, source="s"):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, source if isinstance(source, str) else source[k], None, 7, 8, "k", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1
def test_ann_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [float("inf")] + [0.0] * 23), (None, [1.0] * 24), (5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = ann.nearest(df.where("vec_id % 50 = 0"), df).toPandas()
    pdf = pd.DataFrame(rows, columns=["vec_id", "embedding"])
    want = ann.brute_force(pdf[pdf.vec_id % 50 == 0], pdf)
    met = got.merge(want, on=["query_id", "rank"])
    assert len(met) == len(want) and (met.score_x == met.score_y).mean() > 0.97 and (met.vec_id_x == met.vec_id_y).mean() > 0.95
    top = got[got.query_id == 100].sort_values("rank")
    assert top.vec_id.tolist() == [101, 102, 103, 104, 105]
    assert got.compared.mean() < 200  # the bounds leave most vectors out
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none).count() == 0
    far = spark.createDataFrame([(0, [3e200, 4e200]), (1, [4e-200, 3e-200]), (2, [-3e-320, 1e-320]), (3, [1e308, 1e308])], "vec_id long, embedding array<double>")
    best = {r.vec_id: r.score for r in ann.nearest(far.where("vec_id = 0"), far).collect()}
    assert best == {1: pytest.approx(0.96), 2: pytest.approx(-1 / math.sqrt(10), rel=1e-3), 3: pytest.approx(7 / 5 / math.sqrt(2))}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(few.where("vec_id = 0"), few).collect()] == [(0, 1, 1)]


def test_ann_sends_no_copies_of_queries_through_the_driver(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 7)).alias("embedding"))
    plan = ann.nearest(df.where("vec_id % 50 = 0"), df)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" in plan  # the one side is the numbers of the query blocks


# 2
def plain_png(data):
    lines = b"".join(b"\0" + data[i : i + 64] for i in range(0, len(data), 64))
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (64).to_bytes(4, "big") + (len(data) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def test_broken_html_takes_linear_time():
    for text in ("<!--" * 200_000, "<script>" * 100_000, "<" * 500_000, "<p " + "a" * 500_000 + ">", "<style><" * 100_000):
        media.parse_html(text)
    assert [x["text"] for x in media.parse_html("a<!-- b --> c<script>d</script>e<style>f</style ><b>g < h")] == ["a ceg < h"]


def test_media_round_trip(spark):
    texts = [*ODD, "a", "\0", "a\0\0", "x<!--" * 3000, "<" * 5000, "<script>" * 2000]
    rows = media.media_of_documents(docs(spark, texts, ids=[None, *range(1, len(texts))])).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i or None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        png = plain_png(data)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
    assert by[3].feature == by[len(ODD)].feature
    assert media.media_of_documents(empty(spark)).count() == 0


def test_interleaving_keeps_order_and_captions():
    got = media.parse_html('<p>one &amp; two</p><figure><img src="sha256:aa" alt="x"><figcaption>cap</figcaption></figure>tail<img src="bb" alt="alt"><script>no</script><!-- no -->')
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in got] == [(0, "text", "one & two", None, None), (1, "media", None, "aa", "cap"), (2, "text", "tail", None, None), (3, "media", None, "bb", "alt")]
    assert media.parse_html(None) == media.parse_html("") == []


def test_unresolved_references_stay(spark):
    refs = spark.createDataFrame([(1, 0, "aa", "c"), (1, 2, "zz", None)], "doc_id long, position int, digest string, caption string")
    stored = spark.createDataFrame([("aa", 3)], "digest string, n int")
    assert {(r.position, r.n) for r in media.resolve(refs, stored).collect()} == {(0, 3), (2, None)}


# 3
def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append((" " if rng.random() < 0.5 else "\n").join(words).upper() if rng.random() < 0.3 else " ".join(words))
    texts += [texts[-1], texts[-1], "one two three", "one  two three", "one two"]
    got = ngram_join.jaccard_components(docs(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute_components(texts)
    short = ngram_join.jaccard_components(docs(spark, texts), long=1).collect()  # every list is dealt out
    assert sorted(map(tuple, short)) == sorted(map(tuple, got))


def test_ngram_join_edges(spark):
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    rows = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], ids=[4, None, 4, None])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(rows).collect()), key=str)
    assert got == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 0, None)], key=str)
    kept = ngram_join.keep_one(docs(spark, ["a b c d e f", "A B C d e f", "", None]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == empty(spark).columns
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = docs(spark, [a, a, b, a, b, c, c, None, "", ""], ids=[1, 1, 1, 2, None, None, None, None, 5, 5])
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(rows).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (None, None), (5, ""), (5, "")], key=str)
    assert ngram_join.keep_one(empty(spark)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


# 4
def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        share = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * share >= 2 * sizes[s]}
        if not over:
            return out | {s: weights[s] * share for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    names = [None, "ä", "b", "zz", "Z"]
    texts = [" ".join(["w"] * rng.randint(0, 80)) for _ in range(800)] + [None, " ", "w " * 5000]
    source = [rng.choice([*names, "b", "b", "b"]) for _ in texts]
    rows = mixing.mix(docs(spark, texts, source=source)).toPandas().set_index("doc_id").sort_index()
    sizes = [len((t or "").split()) for t in texts]
    assert rows["size"].tolist() == sizes and (rows.taken <= 2 * rows["size"]).all() and set(rows.copies) <= {0, 1, 2}
    totals = {s: sum(z for z, o in zip(sizes, source, strict=True) if o == s) for s in set(source)}
    want = brute_targets(totals)
    for s in names:
        mine = [i for i, o in enumerate(source) if o == s]
        assert rows.target[mine[0]] == pytest.approx(want[s]) and rows.source_size[mine[0]] == totals[s]
        assert abs(rows.taken[mine].sum() - want[s]) <= 0.01 * want[s] + 40
    again = mixing.mix(docs(spark, texts, source=source)).toPandas().set_index("doc_id").sort_index()
    assert again.taken.tolist() == rows.taken.tolist()


def test_mixing_edges(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()] == [0, 0]
    rows = docs(spark, ["a b", "a b", "c"] * 20, ids=[1, 1, 2] * 20)
    mixed = mixing.apply_mix(rows)
    assert mixed.columns == rows.columns
    assert mixed.count() == sum(r.copies for r in mixing.mix(rows).collect())


def test_mixing_solves_the_dual(spark):
    rng = random.Random(8)
    cells = [(s, z, rng.randint(1, 30)) for s, top in ((None, 40), ("b", 3000), ("c", 5)) for z in sorted({0, 1, *(rng.randint(1, top) for _ in range(20))})]
    goals = []
    for s, part in ((None, 0.05), ("b", 1.9), ("c", 1.2)):
        total = sum(z * n for o, z, n in cells if o == s)
        goals.append((s, total, sum(n for o, _, n in cells if o == s), part * total))
    cells_df, goals_df = spark.createDataFrame(cells, "source string, size long, n_docs long"), spark.createDataFrame(goals, "source string, source_size long, n long, target double")
    got = {r.source: r for r in mixing._solve(cells_df, goals_df, 1.5, 2.0).collect()}
    for s, total, n, target in goals:
        z, k = (np.array([c[i] for c in cells if c[0] == s], float) for i in (1, 2))
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            with np.errstate(over="ignore"):
                taken = (k * z * 2 / (1 + np.exp(-(math.log(3) + mid * z * n / total)))).sum()
            low, high = (mid, high) if taken < target else (low, mid)
        assert got[s].tilt == pytest.approx(mid, rel=1e-5) and abs(mid) > 0.1 and got[s].base == pytest.approx(math.log(3))
    with pytest.raises(RuntimeError):
        mixing._solve(cells_df, goals_df, 1.5, 2.0, rounds=1)


# 5
def test_fixity_finds_what_differs(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>", "x") for i in range(3000)] + [(None, None, None, "y")], "page_id long, url string, html string, digest string")
    kept = fixity.pack(pages)
    assert fixity.audit(kept, fixity.pack(pages)).count() == 0
    copy = pages.withColumn("html", F.when(F.col("page_id").isin(0, 17, 2999), "bad").otherwise(F.col("html"))).where("page_id <> 1500 OR page_id IS NULL")
    got = fixity.audit(kept, fixity.pack(copy)).collect()
    k = {(r.file, r.ordinal): r.digest for r in kept.collect()}
    c = {(r.file, r.ordinal): r.digest for r in fixity.pack(copy).collect()}
    assert {(r.file, r.ordinal) for r in got} == {x for x in k.keys() | c.keys() if k.get(x) != c.get(x)}
    assert {(r.file, r.ordinal) for r in got} == {(0, 0), (0, 17), (2, 2999 - 2048), (1, 1500 - 1024)}  # a lost page moves no other
    one = fixity.root(fixity.tree(kept))
    assert one == fixity.root(fixity.tree(fixity.pack(pages))) != fixity.root(fixity.tree(fixity.pack(copy)))
    none = pages.limit(0)
    assert fixity.audit(fixity.pack(none), fixity.pack(none)).count() == 0
    assert fixity.audit(fixity.pack(none), kept).count() == 3001


def test_fixity_matches_a_brute_force_tree(spark):
    """Roots by plain recursion over slots, 16 at a time; repeated rows and null ids have their slots too."""
    rows = [(i, f"u{i}", f"<p>{i}</p>") for i in (0, 1, 15, 16, 300, 1023, 1024, 70_000)] + [(None, "n", None), (None, "m", "x"), (5, "a", "b"), (5, "a", "b"), (5, "a", "c")]
    kept = fixity.pack(spark.createDataFrame(rows, "page_id long, url string, html string"))
    by = {(r.file, r.ordinal): r for r in kept.collect()}
    assert sum(r.records for r in by.values()) == len(rows) and by[0, 5].records == 3 and sum(f < 0 for f, _ in by) == 2
    raw = lambda u, h: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(h or '')}\r\n\r\n{h or ''}\r\n\r\n".encode()
    assert by[0, 16].digest == hashlib.sha256(raw("u16", "<p>16</p>")).hexdigest() and by[0, 16].offset == sum(by[0, i].length for i in (0, 1, 5, 15))
    level = {(f + 256, n): r.digest for (f, n), r in by.items()}
    for at in range(8):
        above: dict = {}
        for f, n in sorted(level):
            above.setdefault((f, n // 16) if at < 3 else (f // 16, 0), []).append(level[f, n])
        level = {k: hashlib.sha256("".join(v).encode()).hexdigest() for k, v in above.items()}
        if at >= 3 and len(level) == 1 and max(level) == (0, 0):
            break
    assert fixity.root(fixity.tree(kept)) == level[0, 0]


def test_warc_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(0, "http://a/1", "<p>é</p>"), (1, None, None), (2, "http://a/2", "x" * 9000)], "page_id long, url string, html string")
    raw = pages.orderBy("page_id").select(fixity.record(F.col("url"), F.col("html")).alias("value"))
    (tmp_path / "a.warc").write_bytes(b"".join(r.value.encode() for r in raw.collect()) + b"WARC/1.1\r\nContent-Length: 50\r\n\r\ncut")
    got = fixity.read_warc(spark, str(tmp_path / "a.warc")).orderBy("position").collect()
    assert [(r.position, r.url, bytes(r.block).decode(), r.complete) for r in got[:3]] == [(0, "http://a/1", "<p>é</p>", True), (1, "", "", True), (2, "http://a/2", "x" * 9000, True)]
    assert not got[3].complete
    packed = {r.page_id: r for r in fixity.pack(pages).collect()}
    assert [(r.digest, r.length) for r in got[:3]] == [(packed[i].digest, packed[i].length) for i in range(3)]


# 6, 7
def test_quality_learns_and_scores_all(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice("lorem ipsum dolor sit amet elit sed do".split()) + rng.choice(["", ",", "."]) for _ in range(80)) for _ in range(150)]
    bad = [" ".join(rng.choice(["a%%%", "b&&&", "|", "c$$$"]) for _ in range(80)) for _ in range(150)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair] + ODD
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(docs(spark, texts), labels).toPandas().set_index("doc_id")
    assert len(rows) == len(texts) and rows.score.between(0, 1).all()
    held = rows[rows.held_out & (rows.index < 300)]
    assert (held.predicted == 1 - held.index % 2).mean() > 0.95
    assert held.index.tolist() == [i for i in held.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert quality.classify(empty(spark), labels).count() == 0
    assert set(quality.classify(docs(spark, ["a", None]), labels.limit(0)).toPandas().score) == {0.5}


def test_quality_matches_a_plain_fit(spark):
    """Weights by one dense solve over all rows, and the isotonic fit by its min-max formula."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "b,", "C3", "%%", "delta\n"][: 2 + i % 4]) for _ in range(5 + i % 60)) for i in range(400)]
    labels = [(i, int(i % 4 < 2) if rng.random() < 0.9 else 1) for i in range(400)]
    stats = quality.measure(docs(spark, texts))
    model = quality.fit(stats, spark.createDataFrame(labels, "doc_id long, label int"))
    x, y, fold = np.stack([quality.statistics(t) for t in texts]).astype(float), np.array([b for _, b in labels], float), np.array([zlib.crc32(str(i).encode()) % 5 for i in range(400)])
    train = x[fold > 1]
    assert model.mean == pytest.approx(train.mean(0)) and model.std == pytest.approx(np.sqrt(np.maximum(train.var(0), 1e-6)), rel=1e-4)
    z = model.fourier(train)
    beta = np.linalg.solve(z.T @ z + (1e-3 * len(train) + 1e-6) * np.eye(z.shape[1]), z.T @ y[fold > 1])
    assert z @ model.beta == pytest.approx(z @ beta, abs=1e-6)
    apart = fold == 1
    bins = np.round(np.clip(model.fourier(x[apart]) @ beta, -1, 2) * quality.BINS)
    at = np.unique(bins)
    w = np.array([(bins == b).sum() for b in at], float)
    v = np.array([(y[apart][bins == b].sum() + 0.5 * np.mean([y[apart][bins == c].mean() for c in at])) / ((bins == b).sum() + 0.5) for b in at])
    mean = lambda i, j: (v[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    assert model.steps_x == pytest.approx(at / quality.BINS) and model.steps_y == pytest.approx(want)


def test_toxicity_learns_and_cleans(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=40) + (["Idiot,"] if i % 4 == 0 else [])) for i in range(600)] + ODD
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(3, None)], "doc_id long, toxic int")
    rows = toxicity.classify(docs(spark, texts), labels).toPandas().set_index("doc_id")
    assert len(rows) == len(texts) and rows.score.between(0, 1).all()
    held = rows[rows.held_out & (rows.index < 600)]
    assert (held.predicted == (held.index % 4 == 0)).mean() > 0.97
    kept = toxicity.clean(docs(spark, [*texts, texts[1]]), labels).toPandas()
    assert not {i for i in range(0, 600, 4)} & set(kept.doc_id[kept.doc_id < 600]) and list(kept.columns) == empty(spark).columns
    assert toxicity.classify(empty(spark), labels).count() == toxicity.clean(empty(spark), labels).count() == 0
    assert toxicity.classify(docs(spark, [None]), labels.limit(0)).first().predicted == 0


def test_factors_learn_pairs(spark):
    """Toxic where an insult meets a group; either alone, or a group of itself, says little or nothing. From texts to scores."""
    rng = random.Random(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts, labels = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([*rng.choices(words, k=20), *["grumpf"] * insult, *["quorl"] * group]))
        labels.append((i, int(insult != group) if rng.random() < 0.8 else int(insult)))
    y = np.array([x for _, x in labels], float)
    slots = [toxicity.hashed_terms(t) for t in texts]
    right = {}
    for pairs in (True, False):
        model = toxicity.Model()
        model.fit(slots[:2400], y[:2400], pairs=pairs)
        right[pairs] = ((model.margins(slots[2400:]) > 0) == (y[2400:] > 0)).mean()
    assert right[True] > 0.85 > 0.78 > right[False]
    rows = toxicity.classify(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas().set_index("doc_id").sort_index()
    assert (rows.predicted == y)[rows.held_out].mean() > 0.85


def test_association_matches_plain_counts():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(200)]
    y = (rng.random(200) < 0.3).astype(float)
    got = toxicity.association(rows, y, 12)
    for slot in range(12):
        has = np.array([slot in r for r in rows])
        want = 2 * sum(o * math.log(o / (has.sum() * p)) for o, p in ((y[has].sum(), y.mean()), ((1 - y[has]).sum(), 1 - y.mean())) if o)
        assert got[slot] == pytest.approx(want)
    assert not toxicity.association([], np.zeros(0), 3).any() and not toxicity.association(rows, np.ones(200), 12).any()


def test_margins_match_all_pairs():
    rng = np.random.default_rng(2)
    model = toxicity.Model(30)
    model.w0, model.slots, model.values = 0.3, np.arange(10, 25, dtype=np.int32), rng.normal(size=(15, toxicity.FACTORS + 1)).astype(np.float32)
    rows = [np.flatnonzero(rng.random(30) < 0.5).astype(np.int32) for _ in range(20)] + [np.zeros(0, np.int32)]
    for r, margin in zip(rows, model.margins(rows), strict=True):
        t = model.theta[r].astype(float)
        want = 0.3 + t[:, 0].sum() + sum(t[i, 1:] @ t[j, 1:] for i in range(len(r)) for j in range(i))
        assert margin == pytest.approx(want, abs=1e-4)


# 8
RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe_matches_tiktoken(spark):
    rng = random.Random(5)
    texts = [*ODD, "<|endoftext|> it's WE'LL", *["".join(rng.choice("abc é中\n 1.'🙂 sti") for _ in range(200)) for _ in range(60)], "a" * 3000 + "中" * 500]
    rows = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = ENCODER.encode_ordinary(text or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), repr(text)[:80]
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    tokens = bpe.encode_documents(docs(spark, texts), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in bpe.decode(tokens, RANKS).collect())
    assert bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_merges_fresh_words_together(monkeypatch):
    """One look at the ranks for each distinct word; the form before took one for each pair of each step."""

    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    rng, ranks = random.Random(8), Counted(RANKS)
    words = ["".join(rng.choices("abeinorst", k=rng.randint(1, 60))) for _ in range(400)] + ["é" * k + "中" * (k % 3) for k in range(1, 24)]
    encode = bpe._encode(ranks, public_tokenizers.PATTERN)
    ranks.asked = 0
    monkeypatch.setattr(bpe, "MEMO", 50)
    for texts in ([" ".join(words), None, ""], [" ".join(words[:70])] * 3, words[60:]):
        assert [x.tolist() for x in encode(texts)] == [ENCODER.encode_ordinary(t or "") for t in texts]
    assert ranks.asked <= 3 * len(words)


def test_bpe_with_groups_and_missing_bytes():
    run = bpe._encode({b"a": 0, b"b": 1, b"ab": 2}, r"(a)(b)?|c|$")
    assert [x.tolist() for x in run(["abaab", "a"])] == [[2, 0, 2], [0]]
    with pytest.raises(KeyError):
        run(["c"])


def test_bpe_by_higher_order_functions(spark):
    words = [" the", " thanedble", "ing", "é", "🙂🙂", " WE", "a", "zzzzzzz", " 12345"]
    got = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()
    assert {r.word: r.ids for r in got} == {w: ENCODER.encode_ordinary(w) for w in words}


# 9
KINDS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(kind, text):
    digits = [int(c) for c in re.sub("[^0-9]", "", text)]
    luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return [True, kind == 1 and all(int(p) <= 255 for p in text.split(".")), 14 <= len(digits) <= 19 and luhn, 10 <= len(digits) <= 15][kind]


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(KINDS) for m in re.finditer(p, text) if valid(k, m[0]))


def test_pii_base_spans(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "@", ".", "1", "25", "0", "+", " ", "-", "(", "é", "🙂", "4111111111111111", "+1 (234) 555-7890", "x@y.z", "1.2.3.4"]) for _ in range(60)) for _ in range(150)]
    texts += [*ODD, "1" * 5000, "a@b.c%d@e.f.g", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 000000000001.1.1.1", "a" * 20000 + "@b.c"]
    names = ["email", "ip", "card", "phone"]
    for r in pii.Sanitiser(docs(spark, texts)).spans().collect():
        spans = plain_spans(texts[r.doc_id] or "")
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (texts[r.doc_id] or "")[:90]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in spans) for k in range(4))


def test_pii_terms_that_disclose(spark):
    texts = [f"contact zanzibar about x{i} at boss@corp.example now please" for i in range(4)] + [f"please mind the now number {i} about a contact at" for i in range(400)]
    job = pii.Sanitiser(docs(spark, texts))
    found = {r.term for r in job.found.collect()}
    assert "zanzibar" in found and not {"please", "now", "contact"} & found
    spans = {r.doc_id: r.spans for r in job.spans().collect()}
    assert ":8:16" in spans[0] and spans[10] == ""
    clean = {r.doc_id: r.text for r in job.sanitised().collect()}
    assert "boss@" not in clean[0] and "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10]
    assert job.sanitised().columns == empty(spark).columns
    none = pii.Sanitiser(empty(spark))
    assert none.spans().count() == none.sanitised().count() == 0


def test_pii_terms_recur_with_entities(spark):
    """Pairs, counts and disclosures of a plain walk; what is common to a single text only passes by no level."""
    rng = random.Random(9)
    common = ["please", "mind", "the", "words", "common", "here"]
    texts = [f"please mind the common words of this text, number {i}, and call" for i in range(300)]
    texts += [f"{rng.choice(common)} walrus keeper: call +1 (234) 555-7{i:03d} {rng.choice(common)}" for i in range(6)]  # by the prefix
    texts += [f"{rng.choice(common)} quagga at n{i}@corp.example {rng.choice(common)}" for i in range(5)] * 2  # by the domain; copies count once
    texts += [f"card 4111-1111-1111-1111 of okapi {c}" for c in common]  # whole, by prefix and by kind
    texts += [f"host 10.1.2.{i} for tapir {rng.choice(common)}" for i in range(5)]
    texts += [f"the keeper went home, number {i}" for i in range(3)]  # weaker, but beyond the threshold
    texts += ["yak lone@single.example", "ibex 9.8.7.6"]  # single texts
    job = pii.Sanitiser(docs(spark, texts))
    seen, held, where = {}, {}, {}
    for text in set(texts):
        for t in set(re.findall(r"[^\W\d_]{3,}", text.lower())):
            held.setdefault(t, set()).add(text)
        for start, kind, end in plain_spans(text):
            v = text[start:end].lower()
            d = re.sub(r"\D", "", v)
            levels = {0: [v, v[v.index("@") :] if "@" in v else v, *re.findall(r"[^\W\d_]{3,}", v.split("@")[0])], 1: [v, v[: v.rfind(".") + 1] + "*"], 2: [d, d[:6] + "*"], 3: [d, d[:4] + "*"]}[kind]
            for e in [*levels, "*"]:
                where.setdefault(f"{kind}:{e}", set()).add(text)
                for t in set(re.findall(r"[^\W\d_]{3,}", (text[:start] + " " + text[end:]).lower())):  # every window reaches both ends here
                    seen.setdefault((f"{kind}:{e}", t), set()).add(text)
    n, want = len(set(texts)), {}
    for (e, t), both in seen.items():
        n_te, n_t, q = len(both), len(held[t]), len(where[e]) / n
        p = n_te / n_t
        evidence = n_te * math.log(p / q) + (n_t - n_te) * math.log((1 - p) / (1 - q)) if p < 1 else n_te * math.log(1 / q)
        disclosure = 1 - math.log2((n_te + q) / (n_t + 1)) / math.log2(q)
        if p > q and evidence >= math.log(len(seen) / 0.05) and disclosure >= 0.8:
            want[e, t] = (n_te, n_t, disclosure, disclosure >= 0.95)
    got = {(r.entity, r.term): (r.n_te, r.n_t, pytest.approx(r.disclosure), r.removed) for r in job.found.collect()}
    assert got == want
    assert {t for _, t in want} >= {"walrus", "keeper", "quagga", "okapi", "tapir"} and not {"yak", "ibex", *common} & {t for _, t in want}
    assert min(v[0] for v in want.values()) >= 2 and {v[3] for v in want.values()} == {True, False}
    spans = {r.doc_id: r for r in job.spans().collect()}
    assert [spans[i].n_terms for i in (0, 300, len(texts) - 1)] == [0, 2, 0]


# 10
def test_preference_pairs(spark):
    turn = "array<struct<role:string,text:string>>"
    u, a, b = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    rows = spark.createDataFrame([(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, None, [u]), (4, [u], [u, a, u, b]), (5, [], [])], f"pair_id long, chosen {turn}, rejected {turn}")
    got = {r.pair_id: r for r in preference.format_pairs(rows).collect()}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].rejected_mask == ["14:23"]
    assert got[1].rejected[14:23] == "no<|end|>"
    assert (got[2].prefix_turns, got[2].chosen, got[2].chosen_mask) == (2, "", [])
    assert (got[3].prefix_turns, got[3].prompt, got[3].chosen) == (0, "", "") and got[3].rejected != ""
    assert (got[4].prefix_turns, got[4].chosen) == (1, "") and len(got[4].rejected_mask) == 2
    assert (got[5].prompt, got[5].rejected) == ("", "")


def test_preference_from_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "bye"), (2, 0, "user", None), (2, 1, "assistant", "b"), (3, 0, "user", "x"), (None, 0, "user", "x"), (2, None, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: ([t.text for t in r.chosen], [t.text for t in r.rejected]) for r in preference.off_topic_pairs(rows).collect()}
    assert got == {1: (["q", "a"], ["q", "b"]), 2: (["", "b"], ["", "a"])}
    assert preference.off_topic_pairs(rows.limit(0)).count() == 0
    more = [(i, 2 * k + j, ("user", "assistant")[j], f"{i}{k}{j}") for i in (3, 4, 10, 17) for k in range(3) for j in range(2)]
    pairs = {r.pair_id: r for r in preference.off_topic_pairs(spark.createDataFrame(more, "conv_id long, turn long, role string, text string")).collect()}
    after = {3: 4, 4: 10, 10: 17, 17: 3}
    for i in after:
        plain = [f"{i}{k}{j}" for k in range(3) for j in range(2)]
        assert [t.text for t in pairs[i].chosen] == plain
        at = 2 * (i % 3) + 1
        assert [t.text for t in pairs[i].rejected] == [*plain[:at], f"{after[i]}21", *plain[at + 1 :]]
    twice = {r.pair_id: r for r in preference.off_topic_pairs(rows.unionAll(rows)).collect()}
    assert [t.text for t in twice[1].chosen] == ["q", "q", "a", "a"]  # repeated rows are turns of their own
    one = preference.off_topic_pairs(rows.where("conv_id = 1"))
    assert [(r.chosen == r.rejected) for r in one.collect()] == [True]


def test_vocabulary_is_whole():
    assert len(RANKS) == 50_256 and base64.b64decode(b"IQ==") in RANKS
