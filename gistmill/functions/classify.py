"""Topics, templates, domains, tags and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import rules
from gistmill.functions.exprs import argmax_category, contains_any, let


def topic_classify(title: Column, text: Column, table: list | None = None, default: str = rules.TOPIC_DEFAULT) -> Column:
    """Topic with most keyword hits in title and the first 2,000 characters, case ignored; ``table`` has rows (topic, keywords)."""
    full = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 2000)))
    return let(full, lambda t: argmax_category(t, [(n, [k.lower() for k in kws]) for n, kws in (rules.TOPICS if table is None else table)], default))


def curation_text(title: Column, summary: Column, content: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 2000))


def template_classify(text: Column, table: list | None = None, default: str = rules.TEMPLATE_DEFAULT) -> Column:
    """Template with most keyword hits; ``table`` has rows (template, kind, keywords)."""
    return argmax_category(text, [(i, kws) for i, _, kws in (rules.TEMPLATES if table is None else table)], default)


def knowledge_type(template: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, kind, _ in rules.TEMPLATES for x in (i, kind)]), template), F.lit("动态"))


def domain_classify(text: Column, table: list | None = None, default: str = rules.DOMAIN_DEFAULT) -> Column:
    """Domain with most keyword hits; ``table`` has rows (domain, keywords)."""
    return argmax_category(text, rules.DOMAINS if table is None else table, default)


def domain_name(domain: Column) -> Column:
    return F.element_at(F.split(domain, "-", 2), 2)


def subdomains(text: Column, domain: Column, table: dict | None = None) -> Column:
    """The first three labels, in the order of the rules, with a keyword in the text; ``table`` has rows (label, keywords) by domain."""
    none = F.array().cast("array<string>")
    out = F.lit(None).cast("array<string>")
    for name, labels in (rules.SUBDOMAINS if table is None else table).items():
        found = F.array_compact(F.array(*[F.when(contains_any(text, kws), label) for label, kws in labels]))
        out = F.coalesce(out, F.when(domain == name, F.slice(found, 1, 3)))
    return F.coalesce(out, none)


def extract_tags(text: Column, platform: Column, kind: Column, entities: list[str] | None = None) -> Column:
    """Entities named in the text, the platform and the type: sorted by code point, the first ten."""
    # Names and what is searched for them, lowered once for all rows.
    rows = F.array(*[F.struct(F.lit(e).alias("name"), F.lower(F.lit(e)).alias("low")) for e in (rules.ENTITIES if entities is None else entities)]).cast("array<struct<name:string,low:string>>")
    found = let(F.lower(text), lambda t: F.transform(F.filter(rows, lambda e: F.contains(t, e["low"])), lambda e: e["name"]))
    return F.slice(F.array_sort(F.array_distinct(F.concat(found, F.array(platform, kind)))), 1, 10)


def knowledge_id(domain: Column, title: Column, now: Column) -> Column:
    return F.concat_ws("-", F.date_format(now, "yyyy"), F.substring(domain_name(domain), 1, 6), F.substring(F.md5(title), 1, 6))


def find_connections(title: Column, text: Column) -> Column:
    """Hints by words in title or text, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(contains_any(title if where == "title" else text, kws), said) for where, kws, said in rules.CONNECTIONS]))


def topic_platform(title: Column, category: Column) -> Column:
    """Where a topic would be published, by words in title and category."""
    return (
        F.when(contains_any(title, ["短剧", "视频"]) | F.contains(category, F.lit("AIGC")), "抖音 / B站 / 小红书")
        .when(contains_any(category, ["机器人", "硬件"]), "B站 / 公众号")
        .when(contains_any(category, ["知识", "效率"]), "小红书 / 公众号")
        .otherwise("公众号 / 小红书")
    )


def source_type_label(platform: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.SOURCE_LABELS.items() for x in kv]), platform), F.lit(rules.SOURCE_LABEL_DEFAULT))
