"""What lands, by name: each kind of source has a parser, and all of them give the same columns.

Files are read by Spark's own sources, so a path may lie in any store that Spark reads, and a
stream's offsets are those of the file source, kept in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.shared import materialize
from gistmill.sources import feeds

#: Columns of every article, whatever it was read from; what a kind does not tell is null.
ARTICLE = {"kind": "string", "landed": "string", "pos": "long", "platform": "string", "title": "string", "url": "string", "summary": "string", "author": "string", "published": "string", "category": "string", "raw_score": "double", "content": "string", "metadata": "map<string,string>"}


@dataclass(frozen=True)
class Kind:
    """How a landed file becomes articles.

    ``raw`` names the columns that ``parser`` takes, made from ``value`` (the text), ``folder``
    and ``name`` (those of the file, decoded) and ``rel_path``; ``also`` adds columns to what
    the parser gives, as SQL expressions over it. With ``lines`` each line is a payload of its
    own, and files are split between tasks. A kind whose parser compares rows of several files is no stream.
    """

    parser: Callable[[DataFrame], DataFrame]
    raw: Mapping[str, str]
    also: Mapping[str, str] | None = None
    lines: bool = False
    streams: bool = True


KINDS: dict[str, Kind] = {}


def register(name: str, kind: Kind) -> None:
    """Adds a kind; a name that is taken is an error."""
    if name in KINDS:
        raise ValueError(f"there is a kind {name} already")
    KINDS[name] = kind


def _kind(name: str) -> Kind:
    if name not in KINDS:
        raise ValueError(f"no kind {name}; there are {', '.join(sorted(KINDS))}")
    return KINDS[name]


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("+"), F.lit("%2B"))


def _raw(files: DataFrame, kind: Kind, path: str) -> DataFrame:
    """Texts of files with what their paths tell; ``rel_path`` is what follows the folder that was named."""
    return _told(files.select("value", F.url_decode(_plain(F.col("_metadata.file_path"))).alias("landed")), kind, path)


def _told(files: DataFrame, kind: Kind, path: str) -> DataFrame:
    plain, rows = _plain, files.withColumn("__path", F.split("landed", "/"))
    # Names of files may be encoded once more by whoever landed them, as those of urls must be.
    stem = F.regexp_replace(F.element_at("__path", -1), r"\.[A-Za-z0-9]+\z", "")
    name = F.coalesce(F.try_url_decode(plain(stem)), stem)
    root = path.rstrip("/").split("/")[-1]
    parts = {"value": F.col("value"), "folder": F.element_at("__path", -2), "name": name, "rel_path": F.regexp_replace("landed", rf"^.*?/\Q{root}\E/", "")}
    return rows.select("landed", *[parts[source].alias(column) for column, source in kind.raw.items()])


def _articles(rows: DataFrame, name: str, kind: Kind) -> DataFrame:
    rows = rows.withColumns({**{c: F.expr(e) for c, e in (kind.also or {}).items()}, "kind": F.lit(name)})
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in ARTICLE.items()])


def read_landed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Articles of the files of one kind under ``path``, all folders in it included; damaged payloads give what their parser makes of them."""
    kind = _kind(name)
    files = spark.read.text(path, wholetext=not kind.lines, recursiveFileLookup=True)
    return _articles(kind.parser(_raw(files, kind, path)), name, kind)


def pack(files: DataFrame, path: str) -> None:
    """Writes ``files(name, value)``, landed files by the path they would have under ``path``, as a table: many small files are few large ones."""
    files.select("name", "value").write.parquet(path)


def read_packed(spark: SparkSession, name: str, path: str) -> DataFrame:
    """What ``read_landed`` gives for the same files, of a folder that ``pack`` wrote; a kind of lines has them in its texts."""
    kind = _kind(name)
    files = spark.read.schema("name string, value string").parquet(path)
    if kind.lines:
        files = files.withColumn("value", F.explode(F.split("value", r"\r\n|\r|\n", -1)))
    landed = F.concat(F.lit(path.rstrip("/") + "/"), F.col("name"))
    return _articles(kind.parser(_told(files.select("value", landed.alias("landed")), kind, path)), name, kind)


def stream_landed(spark: SparkSession, name: str, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The same as a stream: every file that lands is parsed once."""
    kind = _kind(name)
    if not kind.streams:
        raise ValueError(f"{name} compares files with one another, so it is no stream")
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=not kind.lines, recursiveFileLookup=True)
    return _articles(kind.parser(_raw(files, kind, path)), name, kind)


def collect(spark: SparkSession, landed: Iterable[tuple[str, str]], without: Iterable[str] = (), packed: bool = False) -> DataFrame:
    """Articles of all ``(kind, path)`` but the kinds in ``without``, with ``seq``: by place in ``landed``, then by file, then by place in it.

    Rows are sorted by ranges, so that no task holds a kind or a file whole, and written, as
    the numbers hold for one run of the sort alone. Numbers rise but leave gaps. Nothing to
    read is an error. With ``packed`` the paths are those of tables that ``pack`` wrote. What was
    parsed is written before the sort, which reads its rows twice.
    """
    left, read = set(without), read_packed if packed else read_landed
    parts = [read(spark, name, path).withColumn("__part", F.lit(i)) for i, (name, path) in enumerate(landed) if name not in left]
    if not parts:
        raise ValueError("no source is left to read")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = materialize(rows, "parsed").orderBy("__part", "landed", "pos", "url", "title").withColumn("seq", F.monotonically_increasing_id())
    return materialize(rows.drop("__part"), "collected")


def _feed(raw: DataFrame) -> DataFrame:
    rows = feeds.read_feed_xml(raw)
    return rows.withColumn("published", F.coalesce(F.date_format(feeds.parse_published(F.col("published")), "yyyy-MM-dd"), F.lit("")))


register("feed_xml", Kind(_feed, {"source": "folder", "xml": "value"}, {"platform": "source"}))
register("hot_list", Kind(feeds.read_hot_list_json, {"payload": "value"}))
register("video_search", Kind(feeds.read_video_search_json, {"payload": "value"}))
register("papers", Kind(feeds.read_papers_json, {"payload": "value"}))
register("repo_cards", Kind(feeds.extract_repo_cards, {"html": "value"}))
register("news_cards", Kind(feeds.extract_news_cards, {"html": "value"}))
register("search_hits", Kind(feeds.extract_search_hits, {"query": "folder", "html": "value"}, {"author": "source", "metadata": "map('query', query)"}))
register("account_article", Kind(feeds.extract_account_article, {"url": "name", "html": "value"}, {"pos": "0"}))
register("knowledge_list", Kind(feeds.read_knowledge_list, {"folder": "folder", "payload": "value"}, {"metadata": "map('media_id', media_id, 'folder', folder, 'media_type', media_type)"}))
register("notes", Kind(feeds.parse_notes, {"rel_path": "rel_path", "body": "value"}, {"pos": "0", "url": "rel_path", "content": "body"}, streams=False))
register("candidate_queue", Kind(feeds.parse_candidates, {"payload": "value"}, {"raw_score": "score", "category": "domain_name", "metadata": "map('knowledge_id', knowledge_id, 'template_id', template_id)"}, lines=True))
