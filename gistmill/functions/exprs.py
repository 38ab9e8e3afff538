"""Column builders that the rule functions share. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def han(text: Column) -> Column:
    """The runs of Han in a text, apart: what a word of Han alone is in, if it is in the text."""
    return F.array_join(F.regexp_extract_all(text, F.lit(CJK + "+"), F.lit(0)), " ")


def words(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def hit_count(text: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords a text contains; case matters, so lower both before where it should not.

    The text is bound first: Spark may put what a column stands for into the lambda, where it
    would be computed anew for each keyword.
    """
    return let(text, lambda t: F.size(F.filter(words(keywords), lambda k: F.contains(t, k))))


def hits_apart(text: Column, runs: Column, keywords: Iterable[str]) -> Column:
    """``hit_count`` of a text whose runs of Han are known: words of Han alone are searched there, which for other texts is little."""
    keywords = list(keywords)
    of_han = [k for k in keywords if re.fullmatch("[\u4e00-\u9fff]+", k)]
    rest = [k for k in keywords if k not in of_han]
    counts = [hit_count(where, kws) for where, kws in ((runs, of_han), (text, rest)) if kws]
    return sum(counts[1:], counts[0]) if counts else F.lit(0)


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    return let(text, lambda t: F.exists(words(keywords), lambda k: F.contains(t, k)))


def weighted(text: Column, rules: Iterable[tuple[str, int]]) -> Column:
    """Sum of whole-number weights of the keywords that a text contains."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in rules])
    return let(text, lambda t: F.aggregate(F.filter(rows, lambda r: F.contains(t, r["k"])), F.lit(0), lambda acc, r: acc + r["w"]))


def argmax_category(text: Column, rules: Iterable[tuple[str, list[str]]], default: str) -> Column:
    """The category with most keyword hits; the first in the order of the rules wins ties, and without hits the default."""
    named = list(rules)

    def rate(t: Column, runs: Column) -> Column:
        rows = F.array(*[F.struct(hits_apart(t, runs, kws).alias("n"), F.lit(-i).alias("ord"), F.lit(name).alias("name")) for i, (name, kws) in enumerate(named)])
        return let(F.array_max(rows), lambda best: F.when(best["n"] > 0, best["name"]).otherwise(default))

    return let(text, lambda t: let(han(t), lambda runs: rate(t, runs)))


def strip(text: Column) -> Column:
    """Without white space at either end, ideographic spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))
