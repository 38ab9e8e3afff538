"""Parsers of landed feeds, listings and pages. Raw payloads are columns; nothing here touches a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import rules
from gistmill.functions.curation import parse_published
from gistmill.functions.exprs import contains_any, first_filled, strip
from gistmill.functions.scoring import interest_classify, popularity_score
from gistmill.functions.text import strip_html_basic, strip_html_feed, strip_tags
from gistmill.shared import sized_join
from gistmill.sources import json_list

ATOM = "http://www.w3.org/2005/Atom"
_TEXTS = ", ".join(f"{n} array<string>" for n in ("title", "link", "description", "author", "pubDate"))
_ITEM = f"array<struct<{_TEXTS.replace(' array', ': array')}>>"
_ENTRY = "array<struct<title: array<string>, link: array<struct<_href: string>>, summary: array<string>, author: array<struct<name: array<string>>>, published: array<string>, updated: array<string>>>"
#: What a feed may hold: items in channels or under the root, entries under the root.
FEED = f"channel array<struct<item: {_ITEM}>>, item {_ITEM}, entry {_ENTRY}, _broken string"
_ASIDE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>"


def _landed(rows: DataFrame) -> list[str]:
    """The column that says which file a row came from, where there is one; parsers keep it."""
    return [c for c in ("landed",) if c in rows.columns]


def _first(texts: Column) -> Column:
    return strip(F.coalesce(F.get(texts, 0), F.lit("")))


def _declared(feeds: DataFrame) -> DataFrame:
    """``source, xml`` and what a parser without namespaces does not tell: the default namespace of the root, the prefix of Atom, and whether all prefixes and entities are known."""
    bare = F.regexp_replace("xml", _ASIDE, "")
    rows = feeds.select(*_landed(feeds), "source", "xml", bare.alias("__bare")).withColumn("__root", F.regexp_extract("__bare", r"(?s)<([A-Za-z_][^>]*)>", 1))
    attribute = lambda name: F.regexp_extract("__root", rf"(?s)\sxmlns{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    prefix = F.regexp_extract("__root", rf"(?s)\sxmlns:([\w.-]+)\s*=\s*[\"']{ATOM}[\"']", 1)
    used = F.array_distinct(F.regexp_extract_all("__bare", F.lit(r"</?([A-Za-z_][\w.-]*):"), F.lit(1)))
    given = F.regexp_extract_all("__bare", F.lit(r"\sxmlns:([\w.-]+)\s*="), F.lit(1))
    unknown = F.size(F.array_except(used, F.concat(given, F.array(F.lit("xml"))))) > 0
    entity = F.col("__bare").rlike(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)") & ~F.col("xml").contains("<!ENTITY")
    return rows.select(*_landed(rows), "source", "xml", attribute("").alias("__default"), prefix.alias("__prefix"), (unknown | entity).alias("__odd"))


def read_feed_xml(feeds: DataFrame) -> DataFrame:
    """``feeds(source, xml)`` as entries ``source, pos, title, url, summary, author, published``; RSS items, then Atom entries.

    Spark's XML parser reads each feed. One that is not well-formed, and one that uses a
    prefix or an entity that it does not declare, gives no rows; so does a null or an empty
    one. Items count without a namespace, entries in that of Atom, whatever their prefix, or
    without any, as some feeds leave it out. Of repeated elements the first counts, of links the first with an address. Summaries lose
    their tags and are at most 500 long.
    """
    rows = _declared(feeds.where("xml IS NOT NULL AND trim(xml) <> ''")).where("NOT __odd")
    # A prefix that stands for Atom is taken off; without one, nothing matches.
    prefixed = F.col("__prefix") != ""
    plain = F.when(prefixed, F.regexp_replace(F.col("xml"), F.concat(F.lit(r"(</?)"), F.col("__prefix"), F.lit(":")), F.lit("$1"))).otherwise(F.col("xml"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "attributePrefix": "_", "ignoreSurroundingSpaces": "false"}
    rows = rows.withColumn("__rss", F.from_xml("xml", FEED, options)).withColumn("__atom", F.when(prefixed, F.from_xml(plain, FEED, options)).otherwise(F.col("__rss")))
    rows = rows.where("__rss IS NOT NULL AND __rss._broken IS NULL")
    none = F.array()
    nested = F.flatten(F.transform(F.coalesce("__rss.channel", none), lambda c: F.coalesce(c["item"], none.cast(_ITEM))))
    items = F.when(F.col("__default") == "", F.concat(F.coalesce(nested, none), F.coalesce("__rss.item", none))).otherwise(none)
    entries = F.when(prefixed | F.col("__default").isin(ATOM, ""), F.coalesce("__atom.entry", none)).otherwise(none)
    short = lambda texts: strip_html_feed(_first(texts))
    rss = F.transform(items, lambda x: F.struct(_first(x["title"]).alias("title"), _first(x["link"]).alias("url"), short(x["description"]).alias("summary"), _first(x["author"]).alias("author"), _first(x["pubDate"]).alias("published")))
    url = lambda x: F.coalesce(F.get(F.filter(F.coalesce(x["link"]["_href"], none.cast("array<string>")), lambda h: F.coalesce(h, F.lit("")) != ""), 0), F.lit(""))
    atom = F.transform(entries, lambda x: F.struct(_first(x["title"]).alias("title"), url(x).alias("url"), short(x["summary"]).alias("summary"), _first(F.get(x["author"], 0)["name"]).alias("author"), strip(F.coalesce(F.nullif(F.get(x["published"], 0), F.lit("")), F.get(x["updated"], 0), F.lit(""))).alias("published")))
    found = rows.select(*_landed(rows), "source", F.posexplode(F.concat(rss, atom)).alias("pos", "e"))
    return found.select(*_landed(found), "source", "pos", "e.*")


def normalize_feed_entries(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries as articles, with category and metadata of their source."""
    info = sources.select(F.col("key").alias("source"), "category", F.col("type").alias("__type"), F.col("descr").alias("__descr"))
    rows = sized_join(entries, info, "source", "left")
    day = F.date_format(parse_published(F.col("published")), "yyyy-MM-dd")
    return rows.select(F.col("source").alias("platform"), "pos", F.trim("title").alias("title"), "url", F.substring(strip_html_basic(F.col("summary")), 1, 300).alias("summary"), "author", F.coalesce(day, F.lit("")).alias("published"), "category", F.create_map(F.lit("source_type"), "__type", F.lit("source_desc"), "__descr").alias("metadata"))


_HOT = "data array<struct<target:struct<id:string,title:string,excerpt:string,url:string,created:bigint,detail_count:bigint,vote_count:bigint,author:struct<name:string>>>>"


def read_hot_list_json(raw: DataFrame, least: float = 2.0) -> DataFrame:
    """``raw(payload)``: one article for each target with a title that passes the interest gate."""
    rows = raw.select(*_landed(raw), F.posexplode(F.from_json("payload", _HOT)["data"]).alias("pos", "d")).select(*_landed(raw), "pos", "d.target.*").where("coalesce(title, '') <> ''")
    rows = rows.withColumn("i", interest_classify(F.col("title"), F.col("excerpt"))).where(F.col("i.score") >= least)
    hot = F.coalesce(F.nullif("detail_count", F.lit(0)), F.nullif("vote_count", F.lit(0)), F.lit(0))
    url = F.when(F.coalesce("id", F.lit("")) != "", F.concat(F.lit("https://www.zhihu.com/question/"), "id")).otherwise(F.col("url"))
    return rows.select(*_landed(rows), "pos", F.lit("知乎日报").alias("platform"), "title", url.alias("url"), F.col("excerpt").alias("summary"), F.col("author.name").alias("author"), F.col("created").cast("string").alias("published"), F.col("i.category").alias("category"), popularity_score(F.col("i.score"), (hot, 1)).alias("raw_score"))


_VIDEO = "data struct<result:array<struct<title:string,desc:string,description:string,bvid:string,pubdate:bigint,author:string,owner:struct<name:string>,stat:struct<view:bigint,favorite:bigint,danmaku:bigint>,view:bigint,favorite:bigint,danmaku:bigint>>>"


def read_video_search_json(raw: DataFrame, least: float = 2.0) -> DataFrame:
    """``raw(payload)``: of the first ten results those with a title that pass the interest gate; counters may lie in ``stat`` or beside it."""
    rows = raw.select(*_landed(raw), F.posexplode(F.slice(F.from_json("payload", _VIDEO)["data"]["result"], 1, 10)).alias("pos", "r")).select(*_landed(raw), "pos", "r.*")
    rows = rows.withColumn("title", F.trim(F.regexp_replace("title", r'</?em[^>]*>', ""))).where("coalesce(title, '') <> ''").withColumn("summary", first_filled(F.col("desc"), F.col("description")))
    rows = rows.withColumn("i", interest_classify(F.col("title"), F.col("summary"))).where(F.col("i.score") >= least)
    counts = [(F.coalesce(F.col(f"stat.{n}"), F.col(n)), w) for n, w in (("view", 1), ("favorite", 50), ("danmaku", 30))]
    url = F.when(F.coalesce("bvid", F.lit("")) != "", F.concat(F.lit("https://www.bilibili.com/video/"), "bvid")).otherwise("")
    return rows.select(*_landed(rows), "pos", F.lit("bilibili").alias("platform"), "title", url.alias("url"), "summary", F.coalesce("author", "owner.name").alias("author"), F.col("pubdate").cast("string").alias("published"), F.col("i.category").alias("category"), popularity_score(F.col("i.score"), *counts).alias("raw_score"))


_PAPER = "array<struct<id:string,title:string,summary:string,authors:array<string>,upvotes:bigint>>"


def read_papers_json(raw: DataFrame) -> DataFrame:
    """``raw(payload)``: a list, or an object with one under papers, data or results; the first 30 papers."""
    named = F.from_json("payload", f"papers {_PAPER}, data {_PAPER}, results {_PAPER}")
    papers = F.when(F.ltrim("payload").startswith("["), F.from_json("payload", _PAPER)).otherwise(F.coalesce(named["papers"], named["data"], named["results"]))
    rows = raw.select(*_landed(raw), F.posexplode(F.slice(papers, 1, 30)).alias("pos", "p")).select(*_landed(raw), "pos", "p.*")
    authors = F.array_join(F.transform(F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 3), lambda a: F.substring(a, 1, 30)), ", ")
    summary = F.concat(authors, F.lit(": "), F.substring(F.coalesce("summary", F.lit("")), 1, 180))
    rows = rows.withColumn("i", interest_classify(F.col("title"), F.col("summary")))
    low = F.col("i.score") < 1.5
    return rows.select(*_landed(rows), "pos", F.lit("huggingface").alias("platform"), "title", F.concat(F.lit("https://huggingface.co/papers/"), "id").alias("url"), summary.alias("summary"), authors.alias("author"), F.when(low, "AI技术").otherwise(F.col("i.category")).alias("category"), F.when(low, 3.0).otherwise(F.col("i.score")).alias("raw_score"), F.create_map(F.lit("upvotes"), F.coalesce("upvotes", F.lit(0)).cast("string")).alias("metadata"))


def extract_repo_cards(pages: DataFrame) -> DataFrame:
    """Repositories of a listing ``pages(html)``: names, descriptions and languages are lists that belong together by place."""
    page = F.col("html")
    repo = r'(?s)<h2[^>]*>\s*<a[^>]*href="/([^/"]+)/([^/"]+)"'
    lists = F.arrays_zip(F.regexp_extract_all(page, F.lit(repo), F.lit(1)).alias("owner"), F.regexp_extract_all(page, F.lit(repo), F.lit(2)).alias("name"), F.regexp_extract_all(page, F.lit(r'<p\s+class="[^"]*color-fg-muted[^"]*"[^>]*>\s*([^<]*?)\s*</p>'), F.lit(1)).alias("descr"), F.regexp_extract_all(page, F.lit(r'<span\s+itemprop="programmingLanguage">([^<]+)</span>'), F.lit(1)).alias("lang"))
    rows = pages.select(*_landed(pages), F.posexplode(F.slice(lists, 1, 40)).alias("pos", "r")).select(*_landed(pages), "pos", "r.*").where("owner IS NOT NULL").where(~F.col("owner").isin("login", "signup", "settings", "features", "marketplace", "explore"))
    descr = F.coalesce("descr", F.lit(""))
    rows = rows.withColumn("full", F.concat("owner", F.lit("/"), "name", F.when(descr != "", F.concat(F.lit(": "), F.substring(descr, 1, 80))).otherwise("")))
    summary = F.substring(F.concat(F.substring(descr, 1, 200), F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit(" ["), "lang", F.lit("]"))).otherwise("")), 1, 200)
    rows = rows.where(contains_any(F.lower("full"), rules.AI_TOKENS))
    score = F.greatest(interest_classify(F.col("full"), summary)["score"], F.lit(3.0))
    return rows.select(*_landed(rows), "pos", F.lit("github").alias("platform"), F.substring("full", 1, 120).alias("title"), F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "name").alias("url"), summary.alias("summary"), F.col("owner").alias("author"), F.lit("AI Agent与工程").alias("category"), score.alias("raw_score"))


def extract_news_cards(pages: DataFrame, least: float = 1.5) -> DataFrame:
    """Cards of a digest page: link, title and summary; where no card has a summary, links and titles alone; the first 20."""
    page = F.col("html")
    card = r'(?s)<article\s+class="[^"]*digest-item[^"]*"[^>]*>\s*<a\s+href="(/news/[^"]+)"[^>]*>.*?<h3\s+class="item-title"[^>]*>(.*?)</h3>\s*</header>\s*<p\s+class="item-summary"[^>]*>(.*?)</p>'
    plain = r'(?s)<a\s+href="(/news/[^"]+)"[^>]*>.*?<h3\s+class="item-title"[^>]*>(.*?)</h3>'
    part = lambda p, i: F.regexp_extract_all(page, F.lit(p), F.lit(i))
    whole = F.arrays_zip(part(card, 1).alias("link"), part(card, 2).alias("title"), part(card, 3).alias("summary"))
    bare = F.transform(F.arrays_zip(part(plain, 1).alias("link"), part(plain, 2).alias("title")), lambda x: F.struct(x["link"].alias("link"), x["title"].alias("title"), F.lit("").alias("summary")))
    rows = pages.select(*_landed(pages), F.posexplode(F.slice(F.when(F.size(whole) > 0, whole).otherwise(bare), 1, 20)).alias("pos", "c")).select(*_landed(pages), "pos", "c.link", strip(strip_tags(F.col("c.title"))).alias("title"), strip(strip_tags(F.col("c.summary"))).alias("summary"))
    rows = rows.where(F.length("title") >= 5).withColumn("i", interest_classify(F.col("title"), F.col("summary"))).where(F.col("i.score") >= least)
    return rows.select(*_landed(rows), "pos", F.lit("readaitime").alias("platform"), F.substring("title", 1, 120).alias("title"), F.concat(F.lit("https://www.readaitime.com"), "link").alias("url"), F.substring("summary", 1, 200).alias("summary"), F.col("i.category").alias("category"), F.col("i.score").alias("raw_score"))


def extract_search_hits(pages: DataFrame, most: int = 10) -> DataFrame:
    """Hits of a search page ``pages(query, html)``; items without a linked title are skipped."""
    items = F.slice(F.regexp_extract_all("html", F.lit(r'(?is)<li[^>]*class="[^"]*news-list2[^"]*"[^>]*>.*?</li>'), F.lit(0)), 1, most)
    rows = pages.select(*_landed(pages), "query", F.posexplode(items).alias("pos", "item"))
    get = lambda p, i: strip(strip_tags(F.regexp_extract("item", p, i)))
    head = r'(?s)<h3>.*?<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    return rows.where(F.col("item").rlike(head)).select(*_landed(rows), "query", "pos", get(head, 2).alias("title"), F.trim(F.regexp_extract("item", head, 1)).alias("url"), F.substring(F.regexp_replace(get(r'(?s)<p[^>]*class="[^"]*txt-info[^"]*"[^>]*>(.*?)</p>', 1), r"\s+", " "), 1, 200).alias("summary"), get(r'(?s)<a[^>]*class="[^"]*account[^"]*"[^>]*>(.*?)</a>', 1).alias("source"))


def extract_account_article(pages: DataFrame) -> DataFrame:
    """Body, title and author of an account's page ``pages(url, html)``."""
    page = F.col("html")
    body = first_filled(F.regexp_extract(page, r'(?s)<div[^>]*id="js_content"[^>]*>(.*?)</div>\s*</div>\s*<script', 1), F.regexp_extract(page, r'(?s)<div[^>]*class="[^"]*rich_media_content[^"]*"[^>]*>(.*?)</div>', 1))
    text = strip(F.regexp_replace(strip_tags(body, "\n"), r"\n{3,}", "\n\n"))
    get = lambda p: strip(strip_tags(F.regexp_extract(page, p, 1)))
    return pages.select(*_landed(pages), "url", get(r'(?s)<h1[^>]*class="[^"]*rich_media_title[^"]*"[^>]*>(.*?)</h1>').alias("title"), get(r'(?s)<a[^>]*id="js_name"[^>]*>(.*?)</a>').alias("author"), text.alias("content")).withColumn("content_length", F.length("content"))


_LISTING = "data struct<knowledge_list:array<struct<media_id:string,folder_id:string,title:string,media_type:string>>>"


def read_knowledge_list(raw: DataFrame) -> DataFrame:
    """Items of saved listing pages ``raw(folder, payload)``; rows of folders are skipped."""
    rows = raw.select(*_landed(raw), "folder", F.posexplode(F.from_json("payload", _LISTING)["data"]["knowledge_list"]).alias("pos", "k"))
    return rows.select(*_landed(rows), "folder", "pos", "k.*").where("coalesce(folder_id, '') = ''")


def parse_notes(files: DataFrame) -> DataFrame:
    """``files(rel_path, body)`` as notes: no index or template files, tags of the frontmatter, one note per title, the last path."""
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.md\z", "")
    rows = files.select(*_landed(files), "rel_path", "body", stem.alias("stem")).where(~F.startswith("stem", F.lit("_")) & ~F.contains("rel_path", F.lit("模板")))
    head = F.regexp_extract("body", r"(?s)^---\s*\n(.*?)\n---", 1)
    listed = F.regexp_extract(head, r"tags:\s*\[(.*?)\]", 1)
    tags = F.when(listed == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(listed, ","), lambda t: F.regexp_replace(F.trim(t), r"""^["']+|["']+$""", "")))
    rows = rows.select(*_landed(rows), "rel_path", "stem", F.regexp_replace("stem", r"_v[0-9]+\z", "").alias("title"), tags.alias("tags"), "body")
    last = rows.groupBy("title").agg(F.max("rel_path").alias("rel_path"))
    return rows.join(last, ["title", "rel_path"], "left_semi")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a tree of Markdown files."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("full"))
    return parse_notes(files.select(F.regexp_replace(F.url_decode("full"), rf"^.*?\Q{path.rstrip('/').split('/')[-1]}\E/", "").alias("rel_path"), "body"))


QUEUE = "title string, url string, summary string, platform string, score double, template_id string, knowledge_type string, domain string, domain_name string, subdomains array<string>, tags array<string>, knowledge_id string, yaml_frontmatter string, prompt string, content_fetched boolean, full_content_len int, interpretation string"


def _filled(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return rows.fillna("").fillna(0).fillna(False).withColumns({c: F.coalesce(c, none) for c in ("subdomains", "tags")})


def parse_candidates(raw: DataFrame) -> DataFrame:
    """``raw(payload)`` with one candidate each; missing fields get their defaults, blank payloads are skipped."""
    rows = raw.where("trim(payload) <> ''").select(*_landed(raw), F.from_json("payload", QUEUE).alias("q"))
    return _filled(rows.select(*_landed(rows), "q.*"))


def read_candidate_queue(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """A JSON queue of candidates, one object a line, or with ``document`` one list of all, which is split between tasks; missing fields get their defaults."""
    if document:
        return parse_candidates(json_list.read_objects(spark, path).select("payload"))
    return _filled(spark.read.schema(QUEUE).json(path))


def write_candidate_queue(candidates: DataFrame, path: str) -> None:
    """Writes the queue, one JSON object a line, with the content's length in place of the content."""
    rows = candidates.withColumn("full_content_len", F.length(F.coalesce("full_content", F.lit("")))).drop("full_content")
    rows.select(*[c for c in rows.columns if c in {f.split()[0] for f in QUEUE.split(", ")}]).write.mode("overwrite").json(path)
