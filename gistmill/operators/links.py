"""Joins of articles with pages, sources and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill import rules
from gistmill.functions.exprs import CJK, contains_any
from gistmill.functions.text import full_article_text, strip_tags, text_overlap, tokenize_ngrams
from gistmill.operators.select import needs_full_text
from gistmill.shared import materialize, sized_join


def attach_source_info(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Name, type and category of each article's source; a source that is not listed is named by its key."""
    info = sources.select(F.col("key").alias("__key"), F.col("name").alias("source_name"), F.col("type").alias("source_kind"), F.col("category").alias("source_category"))
    joined = sized_join(articles, info, articles["platform"] == F.col("__key"), "left").drop("__key")
    return joined.withColumn("source_name", F.coalesce("source_name", "platform"))


def attach_full_text(articles: DataFrame, pages: DataFrame, least: int = 500, letters: str = CJK, dense: bool = False) -> DataFrame:
    """Content from ``pages(url, html)`` where an article's is short and the page yields over 200 characters.

    Only the urls needed meet the pages; the body is extracted once per url, after the join.
    With ``dense`` the dense blocks of a page are tried before its container.
    """
    wanted = articles.where(needs_full_text(F.col("content"), F.col("url"), least)).select("url", "platform").distinct()
    bodies = pages.select("url", "html").join(wanted, "url").select("url", "platform", full_article_text(F.col("html"), F.col("platform"), letters, dense).alias("__body")).where("__body IS NOT NULL")
    bodies = bodies.groupBy("url", "platform").agg(F.max("__body").alias("__body"))
    rows = articles.join(bodies, ["url", "platform"], "left")
    fresh = needs_full_text(F.col("content"), F.col("url"), least) & (F.length("__body") > 200)
    return rows.withColumn("content", F.when(fresh, F.col("__body")).otherwise(F.col("content"))).drop("__body").select(*articles.columns)


def new_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items whose media_id was never seen, the first by ``seq`` of each; rows of folders are none."""
    rows = items.where("folder_id IS NULL AND media_id IS NOT NULL")
    first = rows.groupBy("media_id").agg(F.min("seq").alias("__seq")).join(seen.select("media_id"), "media_id", "left_anti")
    return rows.join(first.select("__seq"), rows["seq"] == F.col("__seq"), "left_semi")


def _page_text(page: Column, chars: int = 5120) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_tags(F.substring(page, 1, chars), " "), r"\s+", " "), r"^\s+|\s+\z", "")


def check_links(top: DataFrame, pages: DataFrame) -> DataFrame:
    """Link state of a short digest against a crawl ``pages(url, status)``: skipped, dead or ok."""
    top = materialize(top, "digest")
    found = sized_join(pages, top.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min("status").alias("__status"))
    skipped = (F.coalesce("url", F.lit("")) == "") | contains_any(F.coalesce("url", F.lit("")), rules.SKIP_HOSTS)
    state = F.when(skipped, "skipped").when(F.col("__status").isNull() | (F.col("__status") >= 400), "dead").otherwise("ok")
    return sized_join(top, materialize(found, "states"), "url", "left").withColumn("link", state).drop("__status")


def repair_summaries(top: DataFrame, pages: DataFrame, least: float = 0.7) -> DataFrame:
    """Summaries that differ from their page's beginning are replaced by it; ``fixed`` tells which."""
    top = materialize(top, "digest")
    texts = sized_join(pages, top.select("url").distinct(), "url", "left_semi").select("url", F.substring(_page_text(F.col("html")), 1, 300).alias("__text")).groupBy("url").agg(F.max("__text").alias("__text"))
    rows = sized_join(top, materialize(texts, "texts"), "url", "left")
    fixed = (F.coalesce("__text", F.lit("")) != "") & (text_overlap(F.substring("summary", 1, 200), F.col("__text")) < least)
    return rows.withColumn("fixed", fixed).withColumn("summary", F.when(F.col("fixed"), F.substring("__text", 1, 150)).otherwise(F.col("summary"))).drop("__text")


def check_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(F.col("link") != "skipped").alias("checked"), F.count_if(F.col("link") == "dead").alias("dead"), F.count_if("fixed").alias("fixed"))


def append_index_entries(candidates: DataFrame, index: DataFrame, today: Column) -> DataFrame:
    """New entries of ``index(index_key, rel_path, title)`` from candidates with the same columns and ``seq``.

    A candidate whose path or title the index has is left out, and of candidates that share
    a path or title with an earlier one. Anti joins on (index, path) and (index, title), so
    that a hot index is spread over its paths and titles. Both sides are written once, as each
    is joined several times.
    """
    candidates, index = materialize(candidates, "candidates"), materialize(index.select("index_key", "rel_path", "title"), "index")
    fresh = candidates.join(index.select("index_key", "rel_path").distinct(), ["index_key", "rel_path"], "left_anti").join(index.select("index_key", "title").distinct(), ["index_key", "title"], "left_anti")
    for key in ("rel_path", "title"):
        first = fresh.groupBy("index_key", key).agg(F.min("seq").alias("__seq"))
        fresh = fresh.join(first.select("__seq"), fresh["seq"] == F.col("__seq"), "left_semi")
    entry = F.concat(F.lit("- ["), F.date_format(today, "yyyy-MM-dd"), F.lit("] [["), F.regexp_replace("rel_path", r"\.md", ""), F.lit("|"), F.col("title"), F.lit("]]"))
    return fresh.withColumn("entry", entry)


#: What one key in common is worth; of a subdomain one counts, however many are shared.
_WORTH = {"t": 3, "g": 2, "d": 5, "s": 4}


def _keys(terms: Column, tags: Column, domains: Column, subs: Column) -> Column:
    """All that a side can be met by, as one array of typed keys; nulls are none."""
    typed = lambda kind, c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(typed("t", terms), typed("g", tags), typed("d", domains), typed("s", subs)))


def link_pairs(cands: DataFrame, notes: DataFrame, k: int, hot: int) -> DataFrame:
    """Distinct pairs ``(seq, nid)`` among which the k best notes of each ``cands(seq, keys)`` in ``notes(nid, rel_path, keys)`` are.

    A key is hot if it is a label or more than ``hot`` notes hold it. Pairs that share
    another key are all formed: at most ``hot`` for each key of a candidate. Of the rest,
    what is shared depends on the hot keys of either side alone. So notes with the same hot
    keys are stood for by the first k of them by path, candidates with the same hot keys are
    met once, and the k best of those notes suffice: whatever else ranks before them shares
    another key, and whatever does not ranks behind them. A term in every note so costs k
    pairs a candidate. No group is gathered: ranks are limited before each shuffle.
    """
    held = notes.select("nid", "rel_path", F.explode("keys").alias("key"))
    often = materialize(held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("often")), "often")
    label = F.substring("key", 1, 1).isin("d", "s")
    marked = lambda rows: sized_join(rows, often, "key", "left").withColumn("is_hot", F.coalesce("often", label)).drop("often")
    held, asked = materialize(marked(held), "held"), materialize(marked(cands.select("seq", F.explode("keys").alias("key"))), "asked")
    rare = held.where("NOT is_hot").select("key", "nid").join(asked.where("NOT is_hot").select("key", "seq"), "key").select("seq", "nid")

    group = F.sort_array(F.collect_set("key"))
    noted = held.where("is_hot").groupBy("nid", "rel_path").agg(group.alias("keys")).withColumn("n_group", F.md5(F.concat_ws("\n", "keys")))
    first = F.row_number().over(Window.partitionBy("n_group").orderBy("rel_path", "nid"))
    stand = materialize(noted.withColumn("at", first).where(F.col("at") <= k), "stand")
    wanted = materialize(asked.where("is_hot").groupBy("seq").agg(group.alias("keys")).withColumn("c_group", F.md5(F.concat_ws("\n", "keys"))), "wanted")
    note_groups = stand.where("at = 1").select("n_group", F.explode("keys").alias("key"))
    cand_groups = wanted.groupBy("c_group").agg(F.first("keys").alias("keys")).select("c_group", F.explode("keys").alias("key"))
    kind = F.substring("key", 1, 1)
    worth = sum((F.count_if(kind == c) * _WORTH[c] for c in "tgd"), F.max(F.when(kind == "s", _WORTH["s"]).otherwise(0)))
    met = note_groups.join(cand_groups, "key").groupBy("c_group", "n_group").agg(worth.alias("worth"))
    best = F.row_number().over(Window.partitionBy("c_group").orderBy(F.desc("worth"), "rel_path", "nid"))
    best = met.join(stand.select("n_group", "rel_path", "nid"), "n_group").withColumn("at", best).where(F.col("at") <= k).select("c_group", "nid")
    return rare.unionAll(wanted.select("seq", "c_group").join(best, "c_group").select("seq", "nid")).distinct()


def suggest_links(candidates: DataFrame, notes: DataFrame, k: int = 8, hot: int = 256) -> DataFrame:
    """The k notes with most in common with each candidate: ``seq, rel_path, title, score, n_terms, n_tags, same_domain, same_subdomain, reason``.

    3 for each shared title term, 2 for each shared tag, 5 if the note's path names the
    domain, 4 if its title or path names a subdomain; ties by path. ``reason`` names them,
    of terms and tags the first three in order. All are typed keys that meet in one join;
    ``hot`` decides which are met by groups (``link_pairs``) and changes no result. Null
    titles and tags share nothing. Both sides are written once, as the columns needed.
    """
    labels = sorted({d.split("-", 1)[1] for d, _ in rules.DOMAINS})
    subs = sorted({n for rows in rules.SUBDOMAINS.values() for n, _ in rows})
    named = lambda text, names: F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(text, n))
    both = F.concat_ws("\n", "title", "rel_path")
    notes = notes.select(F.monotonically_increasing_id().alias("nid"), "rel_path", "title", _keys(tokenize_ngrams(F.col("title")), F.col("tags"), named(F.col("rel_path"), labels), named(both, subs)).alias("keys"))
    notes = materialize(notes, "notes")
    cands = materialize(candidates.select("seq", _keys(tokenize_ngrams(F.col("title")), F.col("tags"), F.array("domain_name"), F.col("subdomains")).alias("keys")), "candidates")

    pairs = link_pairs(cands, notes, k, hot)
    rows = pairs.join(cands.select("seq", F.col("keys").alias("c_keys")), "seq").join(notes.select("nid", "rel_path", "keys"), "nid").select("seq", "nid", "rel_path", F.array_intersect("c_keys", "keys").alias("both"))
    typed = lambda c: F.filter("both", lambda x: F.startswith(x, F.lit(c)))
    of = {c: F.transform(typed(c), lambda x: F.substr(x, F.lit(2))) for c in _WORTH}
    many = {c: F.size(typed(c)) for c in _WORTH}
    score = many["t"] * _WORTH["t"] + many["g"] * _WORTH["g"] + F.when(many["d"] > 0, _WORTH["d"]).otherwise(0) + F.when(many["s"] > 0, _WORTH["s"]).otherwise(0)
    best = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("score"), "rel_path", "nid"))
    rows = materialize(rows.withColumn("score", score).withColumn("place", best).where(F.col("place") <= k), "links")
    told = lambda what, c: F.when(F.size(c) > 0, F.concat(F.lit(what), F.array_join(F.slice(F.array_sort(c), 1, 3), ", ")))
    reason = F.concat_ws(" | ", told("关键词匹配: ", of["t"]), F.concat(F.lit("同域: "), F.get(of["d"], 0)), told("共享标签: ", of["g"]), F.concat(F.lit("子域: "), F.get(of["s"], 0)))
    titled = sized_join(notes.select("nid", "title"), rows, "nid", "inner")
    return titled.select("seq", "rel_path", "title", "score", many["t"].alias("n_terms"), many["g"].alias("n_tags"), (many["d"] > 0).alias("same_domain"), (many["s"] > 0).alias("same_subdomain"), reason.alias("reason"))


def version_paths(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """``final_path`` of candidates ``(seq, rel_path)``: the path, or with ``_v2`` to ``_v99`` the first free ones; beyond, the path itself.

    Of a path and its versions, those that ``notes(rel_path)`` has are taken. At most 99
    candidates of a path get a version, so ranks are limited to 99 before the shuffle, and
    the rows then meet their places by path and ``seq``: a path with any number of
    candidates is spread like the rest. Candidates are written once, as they are met twice.
    """
    candidates = materialize(candidates, "candidates")
    stem = F.regexp_replace("rel_path", r"(?:_v[0-9]+)?\.md\z", "")
    number = F.coalesce(F.nullif(F.regexp_extract("rel_path", r"_v([0-9]+)\.md\z", 1), F.lit("")).cast("int"), F.lit(1))
    taken = notes.select(stem.alias("__stem"), number.alias("v")).groupBy("__stem").agg(F.collect_set(F.when(F.col("v") <= 99, F.col("v"))).alias("__taken"))  # 99 at most
    rows = candidates.withColumn("__stem", F.regexp_replace("rel_path", r"\.md\z", ""))
    first = Window.partitionBy("__stem").orderBy("seq")
    placed = rows.select("__stem", "seq").withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= 99)
    free = F.filter(F.sequence(F.lit(1), F.lit(99)), lambda v: ~F.coalesce(F.array_contains("__taken", v), F.lit(False)))
    placed = placed.join(taken, "__stem", "left").select("__stem", F.col("seq").alias("__seq"), F.try_element_at(free, F.col("__place")).alias("__got"))
    rows = rows.join(placed.withColumnRenamed("__stem", "__s"), (F.col("__stem") == F.col("__s")) & (F.col("seq") == F.col("__seq")), "left")
    got = F.col("__got")
    return rows.withColumn("final_path", F.when(got.isNull() | (got == 1), F.concat("__stem", F.lit(".md"))).otherwise(F.concat("__stem", F.lit("_v"), got.cast("string"), F.lit(".md")))).drop("__stem", "__s", "__seq", "__got")


def note_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n"))
