"""Thesis, insights, frameworks and takeaways of an article, all within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill import rules
from gistmill.functions.classify import find_connections, topic_classify
from gistmill.functions.exprs import CJK, contains_any, hit_count, let
from gistmill.functions.scoring import depth_score
from gistmill.functions.text import sanitize_content, split_sentences


def is_garbage_sentence(sentence: Column) -> Column:
    """Too short or long, with markup, a url, code, or without Han."""

    def judge(v: Column) -> Column:
        s, low = v["s"], v["low"]
        return (
            ~F.length(s).between(15, 150)
            | F.regexp_like(s, F.lit("[<>]"))
            | contains_any(low, rules.URL_TOKENS)
            | F.regexp_like(s, F.lit(rules.ASCII_SENTENCE))
            | ~F.regexp_like(s, F.lit(CJK))
            | contains_any(low, rules.CODE_WORDS)
        )

    stripped = F.regexp_replace(sentence, r"(?U)^\s+|\s+\z", "")
    return let(F.struct(stripped.alias("s"), F.lower(stripped).alias("low")), judge)


def _weigh(sentence: Column, table: list) -> Column:
    parts = [hit_count(sentence, kws) * w for w, kws in table]
    return sum(parts[1:], parts[0])


def insight_rank(sentences: Column, least: int = 2, most: int = 5) -> Column:
    """The weightiest sentences of an array, at least 2 each and five at most, in order of weight and then place."""
    rows = F.transform(sentences, lambda s, i: F.struct((-_weigh(s, rules.INSIGHT_WORDS)).alias("w"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(F.filter(rows, lambda r: r["w"] <= -least)), 1, most), lambda r: r["s"])


def best_sentence(sentences: Column) -> Column:
    """The sentence of an array with the highest positive weight, the first of equals; null if none has any."""
    rows = F.transform(sentences, lambda s, i: F.struct(_weigh(s, rules.THESIS_WORDS).alias("w"), (-i).alias("i"), s.alias("s")))
    return F.array_max(F.filter(rows, lambda r: r["w"] > 0))["s"]


def _sentences(text: Column) -> Column:
    return F.filter(split_sentences(text), lambda s: ~is_garbage_sentence(s))


def _thesis(sentences: Column, title: Column) -> Column:
    best = best_sentence(F.filter(sentences, lambda s: F.length(s) >= 20))
    return F.coalesce(best, F.concat(F.lit("📄 "), F.coalesce(title, F.lit(""))))


def extract_insights(text: Column) -> Column:
    """The five weightiest sentences, at least 2, in order of weight and then place."""
    return insight_rank(_sentences(text))


def extract_thesis(text: Column, title: Column) -> Column:
    """The best sentence of 20 characters or more with a positive weight, the first of equals; else the title."""
    return _thesis(_sentences(text), title)


def is_framework_name(name: Column) -> Column:
    return F.length(name).between(4, 30) & F.regexp_like(name, F.lit(CJK)) & let(F.lower(name), lambda low: ~contains_any(low, rules.FRAMEWORK_NOISE))


def is_proper_name(name: Column) -> Column:
    starts = "^(?:" + "|".join(rules.BAD_STARTS) + r"|[0-9]{3,})"
    return ~contains_any(name, rules.BAD_CHARS) & ~F.regexp_like(name, F.lit(starts))


def dedup_frameworks(names: Column) -> Column:
    """The first of those that share their first eight characters, in order."""
    keys = F.transform(names, lambda x: F.substring(x, 1, 8))
    return let(F.struct(names.alias("n"), keys.alias("k")), lambda v: F.filter(v["n"], lambda x, i: F.array_position(v["k"], F.substring(x, 1, 8)) == i + 1))


def extract_frameworks(text: Column) -> Column:
    """Up to five names of frameworks: after introducing words, in quotes, in steps; what starts like a sentence is dropped."""
    clean = lambda c: F.transform(c, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
    intro, quoted, steps, change = (clean(F.regexp_extract_all(text, F.lit(p), F.lit(1))) for p in rules.FRAMEWORK_PATTERNS)
    found = F.concat(
        F.filter(intro, lambda x: is_framework_name(x) & is_proper_name(x)),
        F.filter(quoted, is_framework_name),
        F.filter(steps, lambda x: (F.length(x) >= 6) & is_framework_name(x)),
        F.filter(F.slice(change, 1, 3), lambda x: F.length(x) >= 8),
    )
    return F.slice(dedup_frameworks(F.filter(found, lambda x: is_framework_name(x) & is_proper_name(x) & ~F.endswith(x, F.lit("的")))), 1, 5)


def generate_takeaways(frameworks: Column, insights: Column) -> Column:
    """Up to three hints: from the first three frameworks, then from the first three insights."""
    (s1, s2), (k1, k2) = rules.TAKEAWAY_STEPS, rules.TAKEAWAY_KNOWLEDGE
    from_names = F.transform(
        F.slice(frameworks, 1, 3),
        lambda x: F.when(F.regexp_like(x, F.lit("[三一二四五0-9]步")), F.concat(F.lit(s1), x, F.lit(s2)))
        .when(F.regexp_like(x, F.lit("框架|模型|体系")) & (F.length(x) >= 6), F.concat(F.lit(k1), x, F.lit(k2)))
        .when(F.contains(x, F.lit("从")) & F.contains(x, F.lit("到")), F.concat(F.lit(rules.TAKEAWAY_CHANGE), x)),
    )
    from_text = F.transform(F.slice(insights, 1, 3), lambda x: F.when(contains_any(x, rules.TAKEAWAY_TECH), F.concat(F.lit("💡 "), x)).when(contains_any(x, rules.TAKEAWAY_PEOPLE), F.concat(F.lit("👥 "), x)))
    return F.slice(F.array_compact(F.concat(from_names, from_text)), 1, 3)


def interpretable(content: Column) -> Column:
    """Whether a content can be interpreted: 200 sanitised characters and depth 1.0 or more."""
    ok = let(sanitize_content(content), lambda t: (F.length(t) >= 200) & (depth_score(t) >= 1.0))
    return F.coalesce((content != "") & ok, F.lit(False))


def interpret_articles(articles: DataFrame) -> DataFrame:
    """Insight rows of the articles that can be interpreted: content with 200 sanitised characters and depth 1.0 or more.

    Adds ``thesis, frameworks, insights, takeaways, connections, category, content_length,
    quality_score``; the others are dropped. No shuffle.
    """

    def insight(text: Column, title: Column, sentences: Column) -> Column:
        one = F.struct(extract_frameworks(text).alias("frameworks"), insight_rank(sentences).alias("insights"))
        return F.struct(
            _thesis(sentences, title).alias("thesis"),
            find_connections(F.coalesce(title, F.lit("")), text).alias("connections"),
            topic_classify(title, text).alias("category"),
            let(one, lambda o: F.struct(o["frameworks"].alias("frameworks"), o["insights"].alias("insights"), generate_takeaways(o["frameworks"], o["insights"]).alias("takeaways"))).alias("found"),
        )

    rows = articles.where(F.coalesce("content", F.lit("")) != "").drop("category")
    # The cleaned text and its score are made once and decide first; what is taken from the text follows for the rows that stay.
    judged = F.transform(F.array(sanitize_content(F.col("content"))), lambda t: F.struct(t.alias("text"), depth_score(t).alias("score")))
    rows = rows.withColumn("__c", F.explode(F.filter(judged, lambda c: (F.length(c["text"]) >= 200) & (c["score"] >= 1.0))))
    text, title = F.col("__c.text"), F.col("title")
    rows = rows.withColumn("__i", F.explode(F.transform(F.array(_sentences(text)), lambda s: insight(text, title, s))))
    return rows.select(*[c for c in rows.columns if c not in ("__c", "__i")], F.col("__c.score").alias("quality_score"), "__i.thesis", "__i.connections", "__i.category", "__i.found.*", F.length("content").alias("content_length"))
