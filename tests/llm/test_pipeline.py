"""The corpus pipeline on the smallest tables, each stage against what it promises."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from gistmill.llm import bpe, ngram_join, toxicity
from gistmill.llm.common import load
from tests.llm.test_llm_operators import ENCODER, RANKS, brute_components, plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = load(spark, SF, "documents")
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.toPandas())
    raw, clean, single, private, mixed, tokens = seen
    scores = toxicity.classify(load(spark, SF, "documents"), load(spark, SF, "labels")).toPandas()
    assert set(clean.doc_id) == set(scores.doc_id[scores.predicted == 0])
    clean = clean.sort_values("doc_id").reset_index(drop=True)
    roots = {clean.doc_id[i] for i, _, r in brute_components(clean.text.tolist()) if i == r}
    assert set(single.doc_id) == roots
    assert set(private.doc_id) == roots and not any(plain_spans(t) for t in private.text)
    same = private.merge(single, on="doc_id")
    assert all(a == b for a, b in zip(same.text_x, same.text_y, strict=True) if not plain_spans(b))
    assert set(mixed.doc_id) <= roots and mixed.groupby("doc_id").size().max() <= 2
    for frame in (clean, single, private, mixed):
        assert list(frame.columns) == list(raw.columns)
    assert len(tokens) == len(mixed)
    text = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert all(list(ids) == ENCODER.encode_ordinary(text[i]) for i, ids in zip(tokens.doc_id, tokens.ids, strict=True))
    pieces = {v: k for k, v in RANKS.items()}
    one = tokens.iloc[0]
    assert hashlib.sha256(b"".join(pieces[i] for i in one.ids)).digest() == hashlib.sha256(text[one.doc_id].encode()).digest()
    assert bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) == RANKS


def test_stages_take_odd_rows(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, columns of clashing names, and no rows at all."""
    docs = load(spark, SF, "documents").limit(40)
    odd = docs.limit(1).select(F.col("doc_id").alias("x"))
    text = "the quick brown fox jumps over a lazy dog; write to ann@corp.example"
    rows = [(None, None, None, None, None), (9001, None, "en", "web", 0), (9002, "", "en", None, 0), (9003, " \n", None, "web", 2), (9004, text, "en", "web", 40), (9004, text, "en", "web", 40), (None, text, "en", "web", 40), (9005, "word " * 20_000, "en", "web", 100_000)]
    names = ("key", "terms", "row", "size", "copies", "component", "score", "label", "__d", "n")
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema)).select("*", *[F.lit(f"clash {n}").alias(n) for n in names])
    held = docs.columns
    assert odd.count() == 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == held, name
        got = out.toPandas()
        assert (got["key"] == "clash key").all()
        if name == "toxicity":
            assert len(got[got.doc_id == 9004]) == 2 and got.text.isna().sum() == 2
        if name == "ngram_join":
            assert (got.text == text).sum() == 1 and got.text.isna().sum() == 2 and {9002, 9003, 9005} <= set(got.doc_id)
        if name == "pii":
            assert len(got) == docs.count() and (got.text.dropna().str.contains("ann@corp")).sum() == 0 and got.text.isna().sum() == 2
        if name == "mixing":
            assert got.text.isna().sum() == 0 and len(got[got.doc_id == 9004]) in (0, 2, 4)
        assert stage(spark, docs.limit(0), SF).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(tokens) == docs.count() and (tokens[tokens.doc_id.isin([9001, 9002])].n_tokens == 0).all()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_stages_run_python_on_small_batches(spark, monkeypatch):
    """Whatever hands texts or sets to Python runs inside the stage, with few rows a batch; the caller runs none with batches of its own."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for module in (corpus_pipeline, toxicity, ngram_join):

        def noted(df, *a, write=getattr(module, "materialize", None)):
            if "MapIn" in plan(df):
                seen.append(int(spark.conf.get(name)))
            return write(df, *a)

        monkeypatch.setattr(module, "materialize", noted, raising=False)
    docs = load(spark, SF, "documents")
    for step, stage in corpus_pipeline.STAGES:
        had = len(seen)
        docs = stage(spark, docs, SF)
        assert "MapIn" not in plan(docs), step
        assert len(seen) > had or step in ("pii", "mixing"), step
        assert spark.conf.get(name) == before, step
    assert max(seen) <= 1000


def test_recurring_shingles_are_counted(monkeypatch):
    """Those that occur once in a run are left out, others count as often as they occur, also over several runs."""
    monkeypatch.setattr(ngram_join, "RUN", 500)
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 300, 1800), np.full(1200, 7), np.arange(1100), np.array([5]), np.array([5, 5])):
        got = ngram_join._Recurring()
        got.add(values.astype(np.uint64))
        got.flush()
        want = Counter()
        for at in range(0, len(values), 500):
            want.update({x: n for x, n in Counter(values[at : at + 500].tolist()).items() if n > 1})
        assert {int(i): int(got.counts[i]) for i in np.flatnonzero(got.counts)} == dict(want)
