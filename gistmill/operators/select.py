"""Selections, rankings, caps and aggregates of scored articles. Every order ends with ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill import rules
from gistmill.functions.exprs import contains_any, first_filled
from gistmill.functions.scoring import depth_level, depth_score, to_stars
from gistmill.shared import materialize, sized_join


def select_sources(articles: DataFrame, keys: list[str] | None) -> DataFrame:
    """Rows of the platforms asked for; None means all, and a list without a known one none."""
    return articles if keys is None else articles.where(F.col("platform").isin(*keys) if keys else F.lit(False))


def project_articles(articles: DataFrame, score: Column) -> DataFrame:
    """Served columns; summary and content stand in for each other."""
    return articles.select("seq", "title", F.col("platform").alias("source"), "url", F.substring(first_filled(F.col("summary"), F.col("content")), 1, 300).alias("summary"), F.substring(first_filled(F.col("content"), F.col("summary")), 1, 2000).alias("content"), score.alias("score"), depth_level(score).alias("level"))


def ai_title_filter(articles: DataFrame) -> DataFrame:
    return articles.where(contains_any(F.lower("title"), rules.AI_TOKENS))


def skip_domains(articles: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    return articles.where(~contains_any(F.coalesce("url", F.lit("")), rules.SKIP_HOSTS if hosts is None else hosts))


def needs_full_text(text: Column, url: Column, least: int = 500) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) < least) & (F.coalesce(url, F.lit("")) != "")


def top_articles(articles: DataFrame, n: int, score: str = "raw_score") -> DataFrame:
    """The n best; every partition sends n rows at most to the last task."""
    return articles.orderBy(F.desc(score), "seq").limit(n)


def rank_articles(top: DataFrame, score: str = "raw_score") -> DataFrame:
    """Adds the place in a digest; for limited results only."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "seq")))


def select_deep(articles: DataFrame, n: int = 5, least: float = 4.5) -> DataFrame:
    return top_articles(articles.where(F.col("raw_score") >= least), n)


def cap_per_source(entries: DataFrame, caps: dict[str, int], default: int = 50) -> DataFrame:
    """The first entries of each feed by ``pos``, their place in the feed (from 0): a filter, so no shuffle and no hot source."""
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("platform")), F.lit(default)) if caps else F.lit(default)
    return entries.where(F.col("pos") < cap)


def source_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("platform").agg(F.count("*").alias("n"))


def level_counts(articles: DataFrame, score: str = "score") -> DataFrame:
    level = depth_level(F.col(score))
    return articles.agg(F.count("*").alias("total"), F.count_if(level == "深度").alias("deep_count"), F.count_if(level == "中度").alias("medium_count"), F.count_if(level == "浅层").alias("shallow_count"))


def score_distribution(articles: DataFrame, score: str = "raw_score") -> DataFrame:
    """Rows for each of the five stars, with 0 where there are none; two-phase aggregation into one row, then unpivoted."""
    stars = [to_stars(F.lit(float(s))) for s in (8, 6, 4, 2, 0)]
    one = articles.agg(*[F.count_if(to_stars(F.col(score)) == s).alias(f"c{i}") for i, s in enumerate(stars)])
    return one.select(F.explode(F.array(*[F.struct(s.alias("stars"), F.col(f"c{i}").alias("n")) for i, s in enumerate(stars)])).alias("x")).select("x.stars", "x.n")


def distinct_source_count(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count_distinct("platform").alias("n_sources"))


def category_groups(top: DataFrame) -> DataFrame:
    """Titles of a digest by category, in rank order; for limited, ranked results."""
    return top.groupBy(first_filled(F.col("category"), F.lit("其他")).alias("category")).agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("titles"), F.min("rank").alias("first_rank"))


def industry_table(ranked: DataFrame) -> DataFrame:
    """First item and heat (at most 3) of the first eight categories in order of appearance."""
    rows = ranked.groupBy("category").agg(F.min_by("title", "rank").alias("title"), F.min_by("platform", "rank").alias("platform"), F.least(F.count("*"), F.lit(3)).alias("heat"), F.min("rank").alias("first_rank"))
    return rows.withColumn("title", F.substring("title", 1, 40)).orderBy("first_rank").limit(8)


def topic_histogram(insights: DataFrame) -> DataFrame:
    return insights.groupBy("category").agg(F.count("*").alias("n")).withColumn("bar", F.repeat(F.lit("█"), F.col("n").cast("int")))


def source_footprint(articles: DataFrame, expected: list[str]) -> DataFrame:
    """Each expected source with its count, 0 where there is none."""
    spark = articles.sparkSession
    wanted = spark.createDataFrame([(i, s) for i, s in enumerate(expected)], "ord int, platform string")
    got = articles.where(F.col("platform").isin(*expected)).groupBy("platform").agg(F.count("*").alias("n"))
    # At most one row for each of the names given.
    return wanted.join(F.broadcast(got), "platform", "left").select("ord", "platform", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "✅").otherwise("—").alias("status"))


def focus_categories(ranked: DataFrame) -> DataFrame:
    """Distinct categories of the first three, sorted, and how many there are."""
    return ranked.where("rank <= 3").agg(F.array_sort(F.collect_set("category")).alias("categories")).withColumn("n", F.size("categories"))


def normalize_scores(articles: DataFrame) -> DataFrame:
    """Scores spread over 1 to 5; all 3 where they are equal. The range is one aggregated row, joined by broadcast."""
    bounds = articles.agg(F.min("raw_score").alias("__lo"), F.max("raw_score").alias("__hi")).withColumn("__k", F.lit(1))
    rows = articles.withColumn("__k", F.lit(1)).join(F.broadcast(bounds), "__k")
    value = F.when(F.col("__hi") == F.col("__lo"), 3.0).otherwise(1 + 4 * (F.col("raw_score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return rows.withColumn("raw_score", value).drop("__k", "__lo", "__hi")


def select_digest_sections(articles: DataFrame, n_deep: int = 5, n_brief: int = 15, least: int = 3) -> DataFrame:
    """Rows with ``section`` deep or brief, from ``score``, ``interpretable`` and ``seq``.

    Deep: the interpretable ones of the first five with level 深度; with fewer than three,
    interpretable ones of level 中度 from the top until there are three. Briefs: the first
    15 of level 中度, those that were moved up too. Only top-k results are ranked. What
    decides is written once, so that scores and interpretations are not made anew for each
    section; the rows chosen, some twenty, then meet the articles.
    """
    whole, articles = articles, materialize(articles.select("seq", "score", "interpretable").where("score >= 2"), "sections")
    deep = top_articles(articles.where(F.col("score") >= 4), n_deep, "score").where("interpretable")
    medium = articles.where((F.col("score") >= 2) & (F.col("score") < 4))
    briefs = top_articles(medium, n_brief, "score")
    missing = deep.agg(F.greatest(F.lit(0), F.lit(least) - F.count("*")).alias("__missing")).withColumn("__k", F.lit(1))
    more = rank_articles(top_articles(medium.where("interpretable"), least, "score"), "score").withColumn("__k", F.lit(1)).join(F.broadcast(missing), "__k").where("rank <= __missing").drop("__k", "__missing", "rank")
    chosen = deep.withColumn("section", F.lit("deep")).unionByName(more.withColumn("section", F.lit("deep"))).unionByName(briefs.withColumn("section", F.lit("brief")))
    chosen = materialize(chosen.select("section", F.col("seq").alias("__seq")), "chosen")
    # The few numbers chosen (at most n_deep + least + n_brief) go before the scores of the articles, which so are made for these alone.
    few = whole.where(F.col("seq").isin([r["__seq"] for r in chosen.collect()]))
    return sized_join(few, chosen, few["seq"] == F.col("__seq"), "inner").drop("__seq")


def two_stage_rescore(articles: DataFrame, full: DataFrame, skip: tuple[str, ...] = (), first: int = 15, fetched: int = 10) -> DataFrame:
    """Scores by summary, gives the first ten of the top fifteen (less ``skip``) their full text, and scores all again.

    ``full(url, full_text)`` is joined to the ten rows chosen.
    """
    scored = articles.withColumn("prescore", depth_score(F.col("summary")))
    chosen = top_articles(top_articles(scored, first, "prescore").where(~F.col("platform").isin(*skip) if skip else F.lit(True)), fetched, "prescore").select("seq", "url")
    texts = sized_join(full, materialize(chosen, "chosen"), "url", "inner").groupBy("seq").agg(F.max("full_text").alias("full_text"))
    rows = sized_join(scored, materialize(texts, "texts"), "seq", "left").withColumn("text", first_filled(F.col("full_text"), F.col("summary")))
    return rows.withColumn("score", depth_score(F.col("text"))).drop("full_text")


def headline_rows(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank <= 3").select("rank", "title", F.col("platform").alias("source"), first_filled(F.col("thesis"), F.col("title")).alias("content"))


def topic_rows(ranked: DataFrame) -> DataFrame:
    from gistmill.functions.classify import topic_platform

    return ranked.where("rank <= 3").select("rank", F.concat(F.lit("深度解读: "), F.substring("title", 1, 35)).alias("title"), F.substring(first_filled(F.col("thesis"), F.col("title")), 1, 80).alias("angle"), topic_platform(F.col("title"), F.col("category")).alias("platform"))


def paper_rows(deep: DataFrame, briefs: DataFrame) -> DataFrame:
    """At most eight papers: deep rows of two sources by rank, then briefs of the first 15 whose title names one."""
    dash = F.lit("—")
    one = deep.where(F.col("platform").isin("huggingface", "github")).select(F.lit(0).alias("part"), "rank", F.substring("title", 1, 50).alias("title"), first_filled(F.col("author"), F.col("platform")).alias("org"), F.substring(first_filled(F.col("thesis"), F.col("summary")), 1, 60).alias("point"))
    said = contains_any(F.col("title"), ["论文", "报告", "白皮书", "研究", "arXiv", "发布."])
    two = briefs.where((F.col("rank") <= 15) & said).select(F.lit(1).alias("part"), "rank", F.substring("title", 1, 50).alias("title"), F.substring(F.coalesce("platform", dash), 1, 15).alias("org"), F.coalesce(F.nullif(F.substring("summary", 1, 60), F.lit("")), dash).alias("point"))
    return one.unionByName(two).orderBy("part", "rank").limit(8)
