"""Markdown digests from ranked, limited results: one line column per row, set together in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions.classify import source_type_label
from gistmill.functions.curation import digest_calendar
from gistmill.functions.scoring import star_count, to_stars


def _joined(rows: DataFrame, line: Column, by: str = "\n") -> DataFrame:
    """One row, ``body``: lines in rank order; for results of at most some dozen rows."""
    return rows.select("rank", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), by).alias("body"), F.count("*").alias("n"))


def digest_items(ranked: DataFrame, longest: int = 150) -> DataFrame:
    line = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit("  "), to_stars(F.col("raw_score")), F.lit("\n\n**来源**: "), F.col("platform"), F.lit(" | **类型**: "), source_type_label(F.col("platform")), F.lit("\n\n"), F.trim(F.substring(F.coalesce("summary", F.lit("")), 1, longest)), F.lit("\n\n🔗 ["), F.col("platform"), F.lit("原文]("), F.coalesce("url", F.lit("")), F.lit(")"))
    return ranked.select("rank", line.alias("line"))


def render_digest(ranked: DataFrame, day: Column) -> DataFrame:
    """Flat digest, one row ``body``."""
    body = _joined(digest_items(ranked), F.col("line"), "\n\n---\n\n")
    counts = ranked.agg(F.count_distinct("platform").alias("sources"), F.count("*").alias("articles"))
    when = digest_calendar(day)
    head = F.concat(F.lit("# AI 日报 "), when["shown"], F.lit(" (周"), when["weekday"], F.lit(")\n\n> 📊 **采集源**: "), F.col("sources").cast("string"), F.lit(" 个 | **收录**: "), F.col("articles").cast("string"), F.lit(" 篇\n\n---\n\n"))
    rows = body.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k")
    return rows.select(F.concat(head, "body", F.lit("\n\n---\n\n> 📅 下次更新: "), when["next_run"], F.lit(" 07:00")).alias("body"))


def render_digest_sections(deep: DataFrame, briefs: DataFrame, day: Column) -> DataFrame:
    """Digest of two sections, ``section, body``: interpreted articles with their thesis, and briefs."""
    one = _joined(deep, F.concat(F.lit("### "), F.col("title"), F.lit("\n\n> "), F.coalesce("thesis", F.col("title"))), "\n\n")
    two = _joined(briefs, F.concat(F.lit("- **"), F.col("title"), F.lit("** — "), F.col("platform")))
    head = digest_calendar(day)["shown"]
    return one.select(F.lit("deep").alias("section"), F.concat(F.lit("## 深度 "), head, F.lit("\n\n"), "body").alias("body")).unionByName(two.select(F.lit("brief").alias("section"), F.concat(F.lit("## 快讯\n\n"), "body").alias("body")))


def render_digest_grouped(ranked: DataFrame) -> DataFrame:
    """A digest's lines by category, ``category, n, body``, in order of first appearance by ``first_rank``."""
    stars = F.repeat(F.lit("⭐"), star_count(F.col("raw_score"), "round"))
    rows = ranked.select(F.coalesce(F.nullif("category", F.lit("")), F.lit("其他")).alias("category"), "rank", F.concat(F.lit("- ["), stars, F.lit("] ["), F.col("title"), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(") — "), F.col("platform")).alias("line"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"), F.min("rank").alias("first_rank"))


def render_source_list(sources: DataFrame) -> DataFrame:
    return _joined(sources.withColumn("rank", F.col("ord")), F.concat(F.lit("- **"), F.col("name"), F.lit("** (`"), F.col("key"), F.lit("`) — "), F.col("type")))


def write_digest(digest: DataFrame, path: str, day: str) -> None:
    """Writes a digest, or notes ``(rel_path, body)``, to a table partitioned by the day of the run; a rerun replaces its day alone."""
    rows = digest.withColumn("run_date", F.lit(day))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def write_notes(notes: DataFrame, path: str, day: str) -> None:
    """Writes notes ``(rel_path, body)``; of those with one path the last body in order stays."""
    write_digest(notes.groupBy("rel_path").agg(F.max("body").alias("body")), path, day)
