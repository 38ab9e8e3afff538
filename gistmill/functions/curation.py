"""Columns of curated notes: frontmatter, paths, prompts, parsed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions.exprs import let

#: Answers that stand for nothing.
PLACEHOLDERS = ["无", "无关键数据", "略", "（无）", "暂无"]
#: What is asked of each template; a parameter of the prompt.
HINTS = {"C01-CASE": "类型：案例。", "C02-INDUSTRY": "类型：行业动态。", "C03-METHOD": "类型：方法论/框架。", "C04-PRODUCT": "类型：产品/工具。"}


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))), ", "), F.lit("]"))


def build_frontmatter(row: dict[str, Column], now: Column) -> Column:
    """YAML header from the columns knowledge_id, knowledge_type, domain_name, subdomains, tags, url, platform and score."""
    day = F.date_format(now, "yyyy-MM-dd")
    quoted = lambda key, value: F.concat(F.lit(f'{key}: "'), F.coalesce(value, F.lit("")), F.lit('"'))
    return F.concat_ws(
        "\n",
        F.lit("---"),
        quoted("knowledge_id", row["knowledge_id"]),
        quoted("type", row["knowledge_type"]),
        quoted("domain", row["domain_name"]),
        F.concat(F.lit("subdomain: "), _json_list(row["subdomains"])),
        F.concat(F.lit("tags: "), _json_list(row["tags"])),
        quoted("created", day),
        quoted("updated", day),
        quoted("source", row["url"]),
        quoted("source_type", F.concat(F.lit("行业媒体-"), row["platform"])),
        F.concat(F.lit("depth_score: "), F.format_string("%.1f", row["score"])),
        F.lit("---"),
        F.lit(""),
    )


def safe_path(title: Column, folder: Column, domain: Column) -> Column:
    """``folder/domain/title.md``, the title without characters that paths forbid and at most 60 long."""
    name = F.substring(F.regexp_replace(title, r'[\\/:*?"<>|]', "-"), 1, 60)
    return F.concat_ws("/", folder, domain, F.concat(name, F.lit(".md")))


def knowledge_card(title: Column, content: Column, category: Column, tags: Column, url: Column, now: Column, base: str = "02-专业知识库") -> tuple[Column, Column]:
    """Path and text of a card: frontmatter with a line for each tag, then the content."""
    known = F.when(category.isin("AI技术", "投资分析", "经济趋势", "产业研究"), F.concat_ws("/", F.lit(base), category)).otherwise(base)
    path = F.concat(known, F.lit("/"), F.substring(F.translate(title, "/\\", "--"), 1, 80), F.lit(".md"))
    head = F.concat(F.lit('---\ntitle: "'), title, F.lit('"\nsource_url: "'), url, F.lit('"\ndate: '), F.date_format(now, "yyyy-MM-dd"), F.lit("\ncategory: "), category, F.lit("\ntags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t)), "\n"), F.lit("\n---\n\n"))
    return path, F.concat(head, content, F.lit("\n"))


def build_prompt(content: Column, template: Column, longest: int = 8000) -> Column:
    """Prompt for a deep read; null under 100 characters, and long contents are cut with a note of their length."""
    hints = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])
    note = F.when(F.length(content) > longest, F.concat(F.lit("\n\n[原文共 "), F.length(content).cast("string"), F.lit(f" 字，此处仅截取前 {longest} 字]"))).otherwise("")
    return F.when(F.length(content) >= 100, F.concat(F.lit("# 深度解读任务\n\n"), F.coalesce(F.try_element_at(hints, template), F.lit("")), F.lit("\n\n"), F.substring(content, 1, longest), note))


def parse_section(answer: Column, tag: str) -> Column:
    """Items of the section that a 【tag】 line opens, up to the next: without bullets and numbers, placeholders and short items."""
    body = F.regexp_extract(answer, rf"(?s)\Q{tag}\E\s*\n(.*?)(?=\n【|\z)", 1)

    def item(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(?U)^\s+|\s+\z", ""), r"^[-*•]\s*", ""), r"^[0-9]+[.、]\s*", "")
        return let(bare, lambda b: F.when(b.isin(*PLACEHOLDERS) | (F.length(b) < 6), None).otherwise(b))

    return F.array_compact(F.transform(F.split(F.coalesce(body, F.lit("")), "\n", -1), item))


def parse_sections(answer: Column) -> Column:
    """Struct of an answer's sections with a quality of 1.2 for each insight, takeaway and thesis, at most 10."""
    got = F.struct(*[parse_section(answer, f"【{tag}】").alias(name) for name, tag in (("thesis", "核心论点"), ("category", "主题分类"), ("frameworks", "关键框架"), ("insights", "洞察要点"), ("data_points", "数据看点"), ("takeaways", "行动启发"))])
    first = lambda c: F.coalesce(F.get(c, 0), F.lit(""))
    return let(
        got,
        lambda g: F.struct(
            first(g["thesis"]).alias("thesis"),
            first(g["category"]).alias("category"),
            *[g[n].alias(n) for n in ("frameworks", "insights", "data_points", "takeaways")],
            (F.least(F.lit(100), (F.size(g["insights"]) + F.size(g["takeaways"]) + F.when(F.size(g["thesis"]) > 0, 1).otherwise(0)) * 12) / 10.0).alias("quality_score"),
        ),
    )


def parse_published(value: Column) -> Column:
    """Feed time as a date: ISO, RFC 822 (its weekday is ignored) or seconds since 1970; null if unreadable."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"^[A-Za-z]{3}, ", "")
    return F.coalesce(
        F.when(bare.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.try_to_date(F.regexp_extract(bare, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1), "yyyy-M-d")),
        F.when(bare.rlike(r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}"), F.try_to_date(F.regexp_extract(bare, r"^([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})", 1), "d MMM yyyy")),
        F.when(bare.rlike(r"^[0-9]{9,10}$"), F.to_date(F.timestamp_seconds(F.when(bare.rlike(r"^[0-9]{9,10}$"), bare).cast("long")))),
    )


def digest_calendar(day: Column) -> Column:
    """Struct of the weekday's name, the next run's date and the date as shown."""
    names = F.array(*map(F.lit, ["一", "二", "三", "四", "五", "六", "日"]))
    return F.struct(F.element_at(names, F.weekday(day) + 1).alias("weekday"), F.date_format(F.date_add(day, 1), "yyyy-MM-dd").alias("next_run"), F.date_format(day, "yyyy-MM-dd").alias("shown"))
