"""Row functions on literal inputs with expectations derived by hand from the rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from gistmill.functions import classify, curation, interpret, scoring, text

NOW = datetime.date(2026, 7, 21)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("score", "stars"), [(8.0, 5), (7.9, 4), (2.0, 2), (1.9, 1)])
def test_stars(spark, score, stars):
    assert value(spark, scoring.to_stars(F.lit(score))).count("★") == stars


@pytest.mark.parametrize(("score", "level"), [(4.0, "深度"), (3.9, "中度"), (2.0, "中度"), (1.9, "浅层")])
def test_levels(spark, score, level):
    assert value(spark, scoring.depth_level(F.lit(score))) == level


@pytest.mark.parametrize(("published", "units"), [("2026-07-20", 50), ("2026-07-18", 35), ("2026-07-14", 20), ("2026-07-07", 10), ("2026-07-06", 0), ("2026-08-01", 50), ("", 10), ("Tue, 21 Jul 2026 08:00", 10), (None, 10)])
def test_timeliness(spark, published, units):
    assert value(spark, scoring.timeliness_units(F.lit("标题"), F.lit(published).cast("string"), F.lit(NOW))) == units


def test_interest(spark):
    assert tuple(value(spark, scoring.interest_classify(F.lit("今天天气不错"), F.lit("")))) == ("", 0.0)
    assert tuple(value(spark, scoring.interest_classify(F.lit("AI Agent 微调 显存"), F.lit("")))) == ("效率与自动化", 0.0)


def test_topic_of_sample(spark):
    assert value(spark, classify.topic_classify(F.lit("Agent 可靠性的工程解法"), F.lit(""))) == "AI Agent与工程"
    assert value(spark, classify.topic_classify(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "跨领域综合"


def test_empty_text_has_no_depth(spark):
    assert value(spark, scoring.depth_score(F.lit(""))) == 0.0
    assert value(spark, scoring.depth_score(F.lit(None).cast("string"))) == 0.0


@pytest.mark.parametrize(
    ("lines", "kept"),
    [
        (["function foo() {"], []),
        (["Read more"], []),
        (["", "正文一是一个完整的句子", "", "", "正文二也是一个完整的句子"], ["正文一是一个完整的句子", "", "正文二也是一个完整的句子"]),
        (["  正文前有空格  "], ["  正文前有空格  "]),
    ],
)
def test_sanitize(spark, lines, kept):
    assert value(spark, text.sanitize_content(F.lit("\n".join(lines)))) == "\n".join(kept)


def test_content_status(spark):
    assert value(spark, text.content_status(F.lit("短"))) == "fallback"
    assert value(spark, text.content_status(F.lit("字" * 49 + "a" * 200))) == "low_quality"
    assert value(spark, text.content_status(F.lit("字" * 600))) == "success"
    assert value(spark, text.content_status(F.lit(None).cast("string"))) == "fallback"


def test_frameworks_need_a_name(spark):
    got = value(spark, interpret.extract_frameworks(F.lit("作者提出了飞轮增长模型，从经验驱动到数据驱动的转变。《双循环框架》")))
    assert got == ["增长模型", "双循环框架"]  # the words after the introduction are taken greedily
    assert not any(x.startswith("从") for x in got)


def test_sections(spark):
    got = value(spark, curation.parse_sections(F.lit("【关键框架】\n- 无\n【洞察要点】\n1. 六个字以上的句子")))
    assert got["frameworks"] == [] and got["insights"] == ["六个字以上的句子"] and got["quality_score"] == 1.2


@pytest.mark.parametrize(("raw", "day"), [("2026-7-1", "2026-07-01"), ("Tue, 21 Jul 2026 08:00:00 GMT", "2026-07-21"), ("1784592000", "2026-07-21"), ("nonsense", None), (None, None), ("2026-13-40", None)])
def test_published(spark, raw, day):
    got = value(spark, curation.parse_published(F.lit(raw).cast("string")))
    assert (got and got.isoformat()) == day


def test_overlap_and_ngrams(spark):
    assert value(spark, text.text_overlap(F.lit("a b c"), F.lit("B c d"))) == 0.5
    assert value(spark, text.text_overlap(F.lit(""), F.lit("a"))) == 0.0
    assert sorted(value(spark, text.tokenize_ngrams(F.lit("AI大x模型 a")))) == sorted(["ai", "大模", "模型", "大模型"])


def test_unescape_and_decode(spark):
    rows = spark.createDataFrame([("&eacute;&amp;", bytearray("中文".encode("gbk") * 60), "text/html; charset=gbk"), (None, None, None)], "t string, b binary, c string")
    got = rows.select(text.html_unescape("t").alias("t"), text.decode_body("b", "c").alias("d")).collect()
    assert tuple(got[0]) == ("é&", "中文" * 60) and tuple(got[1]) == (None, None)


def test_card_and_frontmatter(spark):
    path, body = curation.knowledge_card(F.lit("a/b"), F.lit("正文"), F.lit("AI技术"), F.array(F.lit("x")), F.lit("u"), F.lit(NOW))
    assert value(spark, path) == "02-专业知识库/AI技术/a-b.md"
    assert "  - x" in value(spark, body)
    assert value(spark, curation.digest_calendar(F.lit(NOW)))["weekday"] == "二"
