"""Texts are made once a row, however many keywords they are searched for, and no more of them than is used."""

import re

import __spark_entry__
from gistmill.functions import scoring
from gistmill.plans import adapter


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def _made_in_lambdas(plan):
    return re.search(r"(?:contains|regexp_like|rlike)\((?:concat|lower|regexp|coalesce)", plan)


def _small(spark, tmp_path, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_quality_sort_makes_a_text_once(spark, tmp_path):
    at = _small(spark, tmp_path, ["a", None])
    assert not _made_in_lambdas(_plan(__spark_entry__.queries()["quality_sort"](spark, at)))


def test_signal_gate_makes_a_text_once(spark, tmp_path):
    at = _small(spark, tmp_path, ["a", None])
    assert not _made_in_lambdas(_plan(__spark_entry__.queries()["signal_gate"](spark, at)))
    rows = spark.createDataFrame([("深度报告与方法论的拆解", ""), ("深度报告与方法论的拆解", "扫码即可领取"), ("深度", ""), (None, "深度")], "title string, summary string")
    assert scoring.signal_gate(rows).count() == 1
    assert scoring.signal_gate(rows, low=[], deep=["领取"]).count() == 1


def test_summaries_of_odd_texts(spark, tmp_path):
    texts = ["", None, " \n\t" * 900 + "x" * 400, "a" + " \n" * 400 + "b", ("𝒳é知 \f\r\n" * 200), "w " * 300, "\x0b " * 400, "y" * 299 + "   z", "y" * 300 + "  "]
    got = {r.seq: r.summary for r in adapter.articles(spark, _small(spark, tmp_path, texts)).select("seq", "summary").collect()}
    for i, t in enumerate(texts):
        assert got[i] == adapter.LEADS[i % len(adapter.LEADS)] + re.sub(r"[ \t\n\r\f]+", " ", t or "")[:300], i
    plan = _plan(adapter.articles(spark, str(tmp_path)).select("summary"))
    assert "300" in plan and "regexp_replace(regexp_extract" in plan
