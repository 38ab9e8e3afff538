"""Depth scores and interpretations are made once a row, and the dear parts only for rows that need them."""

import random
import re

from gistmill import rules
from gistmill.functions import interpret, scoring, text
from gistmill.operators import select
from gistmill.streaming import items as stream


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def _texts(n=60):
    rng = random.Random(11)
    parts = ["框架", "方法论", "方法轮", "方", "法论", "VS", "vs", "3", "%", "亿", "12万", "倍", "#", "# a", "\n", "\n\n", "\n\n\n", " ", '"', "x" * 21, "总结", "框x架", "大模型", "Agent", "RAG", "a country", "try it", "finally", "*/", "FONT-SIZE: 3", "　", "。", "核心不是参数而是方法。", "但是关键在于流程"]
    return ["", None] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_stream_scores_once(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c")], "seq long, content string, summary string, title string").repartition(2)
    assert _plan(stream.stream_score(rows, 0.5)).count("is_long_form,") == 1


def test_signals_are_those_of_the_patterns(spark):
    texts = _texts(300)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", scoring.article_signals(rows["t"]).alias("s")).collect():
        t = texts[r.i] or ""
        want = {n: bool(re.search(p, t)) for n, p in rules.SIGNALS}
        assert {n: r.s[n] for n in want} == want, t
        assert r.s["section_count"] == len(re.findall(r"(?a)(?:^|\n)#{1,3}\s+(.+)", t)) and r.s["paragraph_count"] == len(re.findall(r"\n\n+", t)) + 1, t
    assert "regexp_extract_all" in _plan(rows.select(scoring.depth_score(rows["t"])))


def test_marks_decide_no_line_otherwise(spark):
    rows = spark.createDataFrame([(t,) for t in _texts(300)], "t string")
    both = rows.selectExpr("explode(split(coalesce(t, ''), '\n')) AS s").select("s")
    lines = both.select(text.is_noise_line(both["s"]).alias("a"), text.is_noise_line(both["s"], text.contains_any(text.F.lower("s"), text._MARKS)).alias("b"))
    assert lines.where("a <> b").count() == 0 and lines.where("a").count() > 0
    # Headlines test every article for what can be interpreted; the marks are looked for first.
    assert "usecallback" in _plan(rows.where(interpret.interpretable(rows["t"])))


def test_sentences_are_split_once(spark):
    rows = spark.createDataFrame([(1, "题", "框架", "c", "s")], "seq long, title string, content string, category string, summary string").repartition(2)
    assert _plan(interpret.interpret_articles(rows)).count("[。！？]") == 1


def test_sections_score_what_they_chose(spark, tmp_path):
    spark.range(40).selectExpr("id AS seq", "'框架 3% 建议' AS content").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    rows = rows.select("seq", scoring.depth_score(rows["content"]).alias("score"), (rows["seq"] % 2 == 0).alias("interpretable"))
    got = select.select_digest_sections(rows)
    assert re.search(r"seq#\d+l? (?:in|inset) ", _plan(got))
    assert sorted((r.section, r.seq) for r in got.select("section", "seq").collect()) == [("deep", i) for i in (0, 2, 4)]
