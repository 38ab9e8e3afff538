"""Text of HTML pages and its cleaning."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from gistmill import rules
from gistmill.functions.exprs import CJK, contains_any, let, strip

#: Containers of article bodies by platform: patterns tried in this order.
SITE_BODIES = {
    "36氪": [r'(?s)<div[^>]*class="[^"]*articleDetailContent[^"]*"[^>]*>(.*?)</div>', r'(?s)<div[^>]*class="[^"]*article-detail[^"]*"[^>]*>(.*?)</div>'],
    "虎嗅": [r'(?s)<div[^>]*class="[^"]*article__content[^"]*"[^>]*>(.*?)</div>', r'(?s)<div[^>]*class="[^"]*article-content[^"]*"[^>]*>(.*?)</div>'],
    "量子位": [r'(?s)<div[^>]*class="[^"]*article[^"]*"[^>]*>(.*?)</div>', r"(?s)<article[^>]*>(.*?)</article>"],
    "爱范儿": [r'(?s)<div[^>]*class="[^"]*c-article-content[^"]*"[^>]*>(.*?)</div>', r"(?s)<article[^>]*>(.*?)</article>"],
    "知乎": [r'(?s)<div[^>]*class="[^"]*RichContent-inner[^"]*"[^>]*>(.*?)</div>'],
    "少数派": [r'(?s)<div[^>]*class="[^"]*article-body[^"]*"[^>]*>(.*?)</div>', r'(?s)<div[^>]*class="[^"]*content[^"]*"[^>]*>(.*?)</div>'],
}
#: Platforms whose pages hold the body as a JSON field, which is tried first: pattern of its escaped text.
SITE_FIELDS = {"知乎": r'(?s)"content"\s*:\s*"(.*?)(?:"\s*,\s*"(?:excerpt|title|comment))'}
_BLOCKS = r"</?(?:div|p|br|h[1-6]|li|tr|section|article|blockquote|pre{more})[^>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


@pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """All HTML entities; the built-in ``unescape_common`` does for the common ones."""
    return text.map(html.unescape, na_action="ignore")


@pandas_udf(T.StringType())
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes as text: charset of the header, else of the page's first 2,000 bytes, else the first of four that reads strictly into over 100 characters, else UTF-8 without what it can't read."""

    def one(raw, kind) -> str | None:
        if raw is None:
            return None
        raw = bytes(raw)
        named = re.search(r"charset=([\w-]+)", kind or "", re.I) or re.search(rb"<meta[^>]*charset=[\"']?([\w-]+)", raw[:2000], re.I)
        names = [n.decode() if isinstance(n := named[1], bytes) else n] if named else []
        for i, name in enumerate([*names, "utf-8", "gbk", "gb2312", "gb18030"]):
            try:
                text = raw.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
            if i < len(names) or len(text) > 100:
                return text
        return raw.decode("utf-8", errors="ignore")

    return pd.Series([one(a, b) for a, b in zip(body, content_type, strict=True)])


def unescape_common(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_tags(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, "<[^>]+>", by)


def strip_html_basic(text: Column) -> Column:
    """Text without tags, white space collapsed and trimmed."""
    return strip(F.regexp_replace(strip_tags(text), r"\s+", " "))


def strip_html_feed(text: Column, longest: int = 500) -> Column:
    """A feed's summary: without tags, the common entities read, white space collapsed, at most 500 long."""
    return F.substring(strip(F.regexp_replace(unescape_common(strip_tags(text)), r"(?U)\s+", " ")), 1, longest)


def extract_text_simple(page: Column, longest: int = 8000, least: int = 100) -> Column:
    """The deep read's own text of a page; null where under 100 characters are left.

    Scripts, styles and comments go, tags become spaces, ten entities are read, runs of
    blanks collapse, lines are trimmed and empty ones dropped; at most 8,000 characters.
    """
    text = F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", "")
    text = strip_tags(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), " ")
    for entity, char in rules.SIMPLE_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(F.regexp_replace(text, r"[ \t]+", " "), "\n", -1), strip)
    return let(F.substring(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 1, longest), lambda t: F.when(F.length(t) >= least, t))


def strip_html_noise(page: Column) -> Column:
    """HTML as plain text: without scripts, styles, comments and drawings; block tags are line ends."""
    text = F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)<svg[^>]*>.*?</svg>", "")
    text = F.regexp_replace(text, r'\s*(?:style|on\w+)="[^"]*"', "")
    text = F.regexp_replace(text, _BLOCKS.format(more="|main|aside"), "\n")
    text = unescape_common(strip_tags(text))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " "), r"^\s+|\s+\z", "")


def extract_heuristic_body(page: Column, letters: str = CJK) -> Column:
    """The 20 best paragraphs by letters less twice the code marks, those over 30 only; null unless the whole is over 200 long.

    ``letters`` is the class that counts, Han by default; ``\\p{L}`` suits other languages.
    """
    text = page
    for tag in ("header", "nav", "footer", "script", "style", "noscript", "svg", "iframe"):
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    text = unescape_common(strip_tags(F.regexp_replace(text, _BLOCKS.format(more=""), "\n")))
    rows = F.transform(
        F.split(text, r"\n\s*\n", -1),
        lambda p, i: F.struct((F.regexp_count(p, F.lit(letters)) - F.regexp_count(p, F.lit(r"[{}();]")) * 2).alias("score"), (-i).alias("ord"), F.regexp_replace(p, r"^\s+|\s+\z", "").alias("text")),
    )
    best = F.slice(F.sort_array(F.filter(rows, lambda r: r["score"] > 30), asc=False), 1, 20)
    return let(F.array_join(F.transform(best, lambda r: r["text"]), "\n\n"), lambda t: F.when(F.length(t) > 200, t))


def extract_site_body(page: Column, platform: Column, sites: dict[str, list[str]] | None = None) -> Column:
    """Text of the platform's body container, or of its JSON field where it has one; null for other platforms and where no pattern matches."""
    out = F.lit(None).cast("string")
    sites = SITE_BODIES if sites is None else sites
    for name, patterns in sites.items():
        found = [F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in patterns]
        if name in SITE_FIELDS:
            field = F.replace(F.replace(F.regexp_extract(page, SITE_FIELDS[name], 1), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
            found = [F.nullif(field, F.lit("")), *found]
        out = F.coalesce(out, F.when(platform == name, strip_html_noise(F.coalesce(*found))))
    return out


#: Elements that hold no article text, and tags at which a block of a page begins or ends.
UNREAD = ("script", "style", "noscript", "svg", "iframe", "template", "head")
BLOCK_TAG = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|td|th|tr|ul)(?:\s[^>]*)?/?>"


def extract_dense_body(page: Column, least: int = 200, density: int = 40) -> Column:
    """Article text of a page by the density of its blocks, whatever the site; null unless over ``least`` long.

    A page is cut at its block tags. A block weighs as many characters, blanks aside, as it
    has out of links, and nothing where links hold over a third. Weights are smoothed over
    neighbours (1, 2, 1), and blocks whose mean reaches ``density`` stay: a short line
    between paragraphs does, a line between lists of links doesn't. A link counts in the
    block where it begins. Null and empty pages give null. One pass over a row, no shuffle.
    """
    text = page
    for tag in UNREAD:
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), "[\x01\x02 \t\r\n]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<a(?:\s[^>]*)?>", "\x01"), r"(?i)</a\s*>", "\x02")
    text = unescape_common(strip_tags(F.regexp_replace(text, BLOCK_TAG, "\n")))
    size = lambda b: F.length(F.translate(b, "\x01\x02 ", ""))
    rows = F.transform(
        F.filter(F.split(text, "\n", -1), lambda b: size(b) > 0),
        lambda b: F.struct(F.trim(F.regexp_replace(F.translate(b, "\x01\x02", ""), " {2,}", " ")).alias("text"), size(b).alias("n"), size(F.regexp_replace(b, "\x01[^\x02]*\x02?", "")).alias("free")),
    )
    rows = F.transform(rows, lambda r: r.withField("weight", F.when(3 * (r["n"] - r["free"]) <= r["n"], r["free"]).otherwise(0)))

    def dense(rows: Column) -> Column:
        at = lambda i: F.coalesce(F.get(rows, i)["weight"], F.lit(0))
        kept = F.filter(rows, lambda r, i: (r["weight"] > 0) & (at(i - 1) + 2 * r["weight"] + at(i + 1) >= 4 * density))
        return F.array_join(F.transform(kept, lambda r: r["text"]), "\n")

    return let(let(rows, dense), lambda t: F.when(F.length(t) > least, t))


def full_article_text(page: Column, platform: Column, letters: str = CJK, dense: bool = False) -> Column:
    """The first body over 200 characters: with ``dense`` that of the dense blocks, then the site's container, else the heuristic one."""
    first = [extract_dense_body(page)] if dense else []
    return F.coalesce(*first, let(extract_site_body(page, platform), lambda t: F.when(F.length(t) > 200, t)), extract_heuristic_body(page, letters))


def parse_item_xml_text(payload: Column) -> Column:
    """Text of a knowledge item: the JSON payload's XML, tags as line ends, entities read, blank runs collapsed."""
    xml = F.coalesce(F.get_json_object(payload, "$.content"), payload)
    return F.regexp_replace(F.regexp_replace(unescape_common(strip_tags(xml, "\n")), r"\n\s*\n+", "\n"), r"^\s+|\s+\z", "")


def _alternatives(pattern: str) -> list[str]:
    """Parts of a pattern between bars that are in no group."""
    parts, depth = [""], 0
    for c in pattern:
        depth += {"(": 1, ")": -1}.get(c, 0) if not parts[-1].endswith("\\") else 0
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


_PARTS = [a for p in rules.NOISE_LINES for a in _alternatives(p)]
#: The same test in two: what stands at a line's start is tried once, the rest anywhere.
_AT_START = r"(?i)^\s*(?:" + "|".join(a.removeprefix(r"^\s*") for a in _PARTS if a.startswith("^")) + ")"
_ANYWHERE = "(?i)" + "|".join(a for a in _PARTS if not a.startswith("^"))
#: What a line, in lower case, holds if the second part matches it.
_MARKS = [re.sub(r"\\(.)", r"\1", a.replace(r"\b", "")).lower() for a in _PARTS if not a.startswith("^")]


def is_noise_line(line: Column, marked: Column | None = None) -> Column:
    """``marked`` tells, if known, whether the line's text holds any of the marks of noise in lower case; without one the marks are not looked for."""
    anywhere = F.regexp_like(line, F.lit(_ANYWHERE))
    return F.regexp_like(line, F.lit(_AT_START)) | (anywhere if marked is None else marked & anywhere)


def sanitize_content(text: Column) -> Column:
    """Lines of prose: lines of code and markup go, and short ones without Han; blank runs shrink to one line, none leads."""
    # A line is stripped only where a blank is at an end, and looked through for marks only where its text holds one.
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.right(x, F.lit(1)))
    bare = lambda x: F.when(F.regexp_like(ends(x), F.lit(r"(?U)\s")), strip(x)).otherwise(x)

    def prose(text: Column, marked: Column) -> Column:
        judged = lambda x: let(bare(x), lambda s: F.when(s == "", "").when((F.length(s) < 15) & ~F.regexp_like(s, F.lit(CJK)), F.lit(None)).when(is_noise_line(s, marked), F.lit(None)).otherwise(x))
        return F.transform(F.split(text, "\n", -1), judged)

    lines = let(F.coalesce(text, F.lit("")), lambda t: let(contains_any(F.lower(t), _MARKS), lambda m: prose(t, m)))
    kept = F.array_compact(lines)
    return let(kept, lambda k: F.array_join(F.filter(k, lambda x, i: (x != "") | ((i > 0) & (F.get(k, F.greatest(i - 1, F.lit(0))) != ""))), "\n"))


def content_quality(text: Column) -> Column:
    """Struct ``noise_ratio`` (of all lines, two digits), ``cjk``, ``total_lines``, ``noise_lines``; empty texts have ratio 1."""
    lines = F.split(text, "\n", -1)
    noise = F.size(F.filter(lines, lambda x: is_noise_line(F.trim(x))))
    empty = F.coalesce(text, F.lit("")) == ""
    return F.struct(
        F.when(empty, 1.0).otherwise(F.round(noise / F.size(lines), 2)).alias("noise_ratio"),
        F.when(empty, 0).otherwise(F.regexp_count(text, F.lit(CJK))).alias("cjk"),
        F.when(empty, 0).otherwise(F.size(lines)).alias("total_lines"),
        F.when(empty, 0).otherwise(noise).alias("noise_lines"),
    )


def content_status(text: Column, most_noise: float = 0.3, least_cjk: int = 50) -> Column:
    """Route of a deep read: fallback (under 200 characters), low_quality, success (500 and more) or partial."""
    quality = content_quality(text)
    return F.when(F.length(F.coalesce(text, F.lit(""))) < 200, "fallback").otherwise(
        let(quality, lambda q: F.when((q["noise_ratio"] > most_noise) | (q["cjk"] < least_cjk), "low_quality").when(F.length(text) >= 500, "success").otherwise("partial"))
    )


def split_sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), "[。！？]", -1)


def text_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-case words; 0 if either has none."""
    one, two = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)[\w\x{4e00}-\x{9fff}]+"), F.lit(0))) for x in (a, b))
    return let(F.struct(one.alias("a"), two.alias("b")), lambda v: F.when((F.size(v["a"]) == 0) | (F.size(v["b"]) == 0), 0.0).otherwise(F.size(F.array_intersect(v["a"], v["b"])) / F.size(F.array_union(v["a"], v["b"]))))


def tokenize_ngrams(text: Column) -> Column:
    """Distinct lower-case Latin words of two letters and more, and 2- to 4-grams of the text's Han characters alone, but for grams of function characters."""
    latin = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    han = F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", "")

    def gram(h: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(h) - (n - 1), F.lit(1)))
        return F.when(F.length(h) >= n, F.transform(places, lambda i: F.substring(h, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    all_ = let(han, lambda h: F.concat(gram(h, 2), gram(h, 3), gram(h, 4)))
    return F.array_distinct(F.concat(latin, F.filter(all_, lambda g: ~F.regexp_like(g, F.lit(f"^[{rules.FUNCTION_CHARS}]+$")))))
