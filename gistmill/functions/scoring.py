"""Article scores. Every weight is a short decimal, so sums are kept in whole units and rounded half up once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill import rules
from gistmill.functions.exprs import contains_any, han, hit_count, hits_apart, let, weighted


def _text(title: Column, summary: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))


def relevance_units(title: Column, text: Column) -> Column:
    """Relevance in twentieths, at most 200; both texts in lower case. A keyword in two tiers counts twice."""
    rows = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(w).alias("w")) for w, kws in rules.RELEVANCE.items() for k in kws])
    total = F.aggregate(rows, F.lit(0), lambda acc, r: acc + F.when(F.contains(title, r["k"]), r["w"] * 15).when(F.contains(text, r["k"]), r["w"] * 8).otherwise(0))
    return F.least(F.lit(200), total)


def density_units(text: Column) -> Column:
    """Information density in twentieths, at most 200."""
    found = [F.least(F.regexp_count(text, F.lit(p)), F.lit(3)) * int(w * 2) for p, w in rules.DENSITY]
    total = sum(found[1:], found[0]) + F.least(F.regexp_count(text, F.lit(rules.COMPANY)), F.lit(5)) * 2 + F.least(F.regexp_count(text, F.lit(rules.STRUCTURE)), F.lit(5))
    size = F.length(text)
    share = F.when(size < 200, 3).when(size < 500, 6).when(size < 1000, 8).otherwise(10)
    return F.least(F.lit(200), total * share)


def exclusivity_units(title: Column, source: Column) -> Column:
    """Exclusivity in tenths, at most 100."""
    authority = F.create_map(*[x for k, v in rules.AUTHORITY.items() for x in (F.lit(k), F.lit(round(v * 10)))])
    known = F.coalesce(F.try_element_at(authority, source), F.lit(round(rules.AUTHORITY_DEFAULT * 10)))
    return F.least(F.lit(100), weighted(title, rules.EXCLUSIVE) * 10 + known + F.regexp_count(title, F.lit(rules.INTERVIEW)) * 15)


def timeliness_units(title: Column, published: Column, now: Column) -> Column:
    """Timeliness in tenths, at most 100; dates in the future count as fresh, unreadable ones as 10."""
    day = F.when(published.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(published, "yyyy-M-d"))
    age = F.datediff(now, day)
    fresh = F.when(day.isNull(), 10).when(age <= 1, 50).when(age <= 3, 35).when(age <= 7, 20).when(age <= 14, 10).otherwise(0)
    events = weighted(title, [(k.lower(), w) for w, kws in rules.EVENTS.items() for k in kws]) * 5
    return F.least(F.lit(100), fresh + events + F.regexp_count(title, F.lit(rules.HEAT)) * 10)


def relevance_score(title: Column, summary: Column) -> Column:
    return let(F.struct(F.lower(title).alias("t"), _text(title, summary).alias("x")), lambda v: relevance_units(v["t"], v["x"]) / 20.0)


def density_score(title: Column, summary: Column) -> Column:
    return let(_text(title, summary), lambda x: density_units(x) / 20.0)


def exclusivity_score(title: Column, source: Column) -> Column:
    return let(F.lower(title), lambda t: exclusivity_units(t, source) / 10.0)


def timeliness_score(title: Column, published: Column, now: Column) -> Column:
    return let(F.lower(title), lambda t: timeliness_units(t, published, now) / 10.0)


def four_dim_tenths(title: Column, summary: Column, source: Column, published: Column, now: Column) -> Column:
    return let(
        F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("t"), _text(title, summary).alias("x")),
        lambda v: F.floor((relevance_units(v["t"], v["x"]) * 8 + density_units(v["x"]) * 5 + exclusivity_units(v["t"], source) * 8 + timeliness_units(v["t"], published, now) * 6 + 20) / 40).cast("int"),
    )


def four_dim_score(articles: DataFrame, now: Column) -> DataFrame:
    """Adds ``raw_score``, 0 to 10 in steps of 0.1: relevance 0.40, density 0.25, exclusivity 0.20, timeliness 0.15."""
    return articles.withColumn("raw_score", four_dim_tenths(F.col("title"), F.col("summary"), F.col("platform"), F.col("published"), now) / 10.0)


def category_weight(articles: DataFrame, weights: dict[str, float] | None = None, default: float = rules.CATEGORY_DEFAULT) -> DataFrame:
    """Multiplies ``raw_score`` by the weight, in hundredths, of the article's category; not rounded again."""
    weights = rules.CATEGORY_WEIGHTS if weights is None else weights
    known = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(round(v * 100)))]) if weights else F.create_map().cast("map<string,int>")
    weight = F.coalesce(F.try_element_at(known, F.col("category")), F.lit(round(default * 100)))
    return articles.withColumn("raw_score", F.round(F.col("raw_score") * 10).cast("long") * weight / 1000.0)


def min_score_filter(articles: DataFrame, least: float = 1.0) -> DataFrame:
    return articles.where(F.col("raw_score") >= least)


def to_stars(score: Column) -> Column:
    n = F.when(score >= 8, 5).when(score >= 6, 4).when(score >= 4, 3).when(score >= 2, 2).otherwise(1)
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def star_count(score: Column, mode: str = "half") -> Column:
    """Number of stars shown: ``half`` is the score halved and cut off, ``round`` the score rounded half to even; both 1 to 5."""
    value = F.floor(score / 2) if mode == "half" else F.bround(score)
    return F.greatest(F.lit(1), F.least(F.lit(5), value.cast("int")))


def _found(pattern: str, text: Column, runs: Column) -> Column:
    """Whether a pattern of ``rules.SIGNALS`` is in a text with these runs of Han: its plain words are searched as such, which costs less than a pattern."""
    plain, rest = [], []
    for part in pattern.split("|"):
        choice = re.fullmatch(r"(\w*)\[(\w+)\](\w*)", part)
        if choice:
            plain += [choice[1] + c + choice[3] for c in choice[2]]
        else:
            (plain if re.fullmatch(r"\w+", part) else rest).append(part)
    tests = [F.contains(runs if re.fullmatch("[\u4e00-\u9fff]+", w) else text, F.lit(w)) for w in plain]
    # One digit before a sign tells as much as all of them.
    signs = [m[1] for part in rest if (m := re.fullmatch(r"\[0-9\]\+(\w|%)", part))]
    if rest:
        tests.append(text.rlike(f"[0-9][{''.join(signs)}]" if len(signs) == len(rest) else "|".join(rest)))
    return reduce(lambda a, b: a | b, tests)


def _signals(text: Column, runs: Column) -> Column:
    flags = [_found(p, text, runs).alias(n) for n, p in rules.SIGNALS]
    counted = lambda mark, p: F.when(F.contains(text, F.lit(mark)), F.regexp_count(text, F.lit(p))).otherwise(0)
    return F.struct(
        (F.length(text) > 3000).alias("is_long_form"),
        (F.length(text) > 5000).alias("is_deep"),
        counted("#", r"(?:^|\n)#{1,3}\s+(.+)").alias("section_count"),
        (counted("\n\n", r"\n\n+") + 1).alias("paragraph_count"),
        *flags,
    )


def article_signals(text: Column) -> Column:
    """Struct of two lengths, two counts and eight pattern flags of a text; null counts as empty."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(han(t), lambda h: _signals(t, h)))


def depth_tenths(text: Column) -> Column:
    """Depth score in tenths, at most 100."""

    def total(sig: Column, lower: Column, runs: Column) -> Column:
        parts = F.when(sig["is_deep"], 15).when(sig["is_long_form"], 8).otherwise(0)
        parts += F.when(sig["section_count"] >= 5, 10).when(sig["section_count"] >= 3, 5).otherwise(0)
        parts += F.when(sig["paragraph_count"] >= 15, 5).otherwise(0)
        for name, tenths in rules.DEPTH_TENTHS.items():
            parts += F.when(sig[name], tenths).otherwise(0)
        return F.least(F.lit(100), parts + F.least(F.lit(10), hits_apart(lower, runs, [k.lower() for k in rules.DEPTH_WORDS])))

    def parts(t: Column, h: Column) -> Column:
        return let(F.struct(_signals(t, h).alias("s"), F.lower(t).alias("l"), h.alias("h")), lambda v: total(v["s"], v["l"], v["h"]))

    return let(F.coalesce(text, F.lit("")), lambda t: let(han(t), lambda h: parts(t, h)))


def depth_score(text: Column) -> Column:
    return depth_tenths(text) / 10.0


def depth_level(score: Column) -> Column:
    return F.when(score >= 4, "深度").when(score >= 2, "中度").otherwise("浅层")


def interest_classify(title: Column, summary: Column, table: list | None = None) -> Column:
    """Struct ``category, score``: best of five categories by weight and hits, less 2 for each technical word, not under 0; without a domain word ("", 0).

    ``table`` has rows (category, weight, keywords), by default those of ``rules.INTEREST``.
    """
    table = rules.INTEREST if table is None else table

    def rate(text: Column) -> Column:
        rows = []
        for i, (name, weight, kws) in enumerate(table):
            n = hit_count(text, [k.lower() for k in kws])
            rows.append(F.struct(F.when(n > 0, n * 5 + round(weight * 10)).otherwise(0).alias("tenths"), F.lit(-i).alias("ord"), F.when(n > 0, name).otherwise("").alias("name")))
        best = F.array_max(F.array(*rows))
        penalty = hit_count(text, [k.lower() for k in rules.PENALTY]) * 20
        found = contains_any(text, [k.lower() for k in rules.DOMAIN_WORDS])
        return F.struct(F.when(found & (best["tenths"] > 0), best["name"]).otherwise("").alias("category"), (F.when(found, F.greatest(F.lit(0), best["tenths"] - penalty)).otherwise(0) / 10.0).alias("score"))

    return let(_text(title, summary), rate)


def interest_gate(articles: DataFrame, least: float = 2.0) -> DataFrame:
    return articles.where(interest_classify(F.col("title"), F.col("summary"))["score"] >= least)


def popularity_score(interest: Column, *weighted_counters: tuple[Column, int]) -> Column:
    """Interest twice, and counters with weights in hundredths."""
    units = F.round(interest * 200).cast("long")
    for counter, hundredths in weighted_counters:
        units += F.coalesce(counter, F.lit(0)) * hundredths
    return units / 100.0


def signal_gate(articles: DataFrame, low: list[str] | None = None, deep: list[str] | None = None) -> DataFrame:
    """Rows without a sign of low quality, with a title of 10 or more characters and a sign of depth; both lists can be given."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    # The patterns are literals, compiled once, and the text of a row is made once for all of them.
    bad = lambda t: reduce(lambda a, b: a | b, [t.rlike(p) for p in (rules.LOW_QUALITY if low is None else low)], F.lit(False))
    return articles.where((F.length("title") >= 10) & let(text, lambda t: (quality_signals(t, deep) >= 1) & ~bad(t)))


def quality_signals(text: Column, deep: list[str] | None = None) -> Column:
    return hit_count(text, rules.DEEP_SIGNALS if deep is None else deep)


def quality_sort(articles: DataFrame) -> DataFrame:
    """Orders by the number of depth signals, most first."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return articles.withColumn("n_signals", quality_signals(text)).orderBy(F.desc("n_signals"), "seq")
