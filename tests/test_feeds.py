"""Feeds as they come: odd quotes, namespaces, entities, comments and damage, against the parser of the standard library."""

import re
import xml.etree.ElementTree as ET

import pytest

from gistmill.sources import feeds

ATOM = "http://www.w3.org/2005/Atom"
RSS = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>feed</title><link>https://x.example</link>{}</channel></rss>'
FEEDS = {
    "plain": RSS.format("<item><title>one</title><link>https://x.example/1</link><description>a &lt;b&gt;bold&lt;/b&gt; word</description><author>ann</author><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>two</title></item>"),
    "single quotes": f"<feed xmlns='{ATOM}'><title>t</title><entry><title>a</title><link rel='self' href=''/><link href='https://x.example/a'/><updated>2024-01-02</updated></entry></feed>",
    "unclosed": RSS.format("<item><title>one</title><bad></item>"),
    "references": RSS.format("<item><title>it&#8217;s &#x41; &amp; b</title><description>&amp;nbsp;x&#160;y</description></item>"),
    "line end": RSS.format("<item\n ><title\n>one</title\n></item\n>"),
    "comment": RSS.format("<!-- <item><title>hidden</title></item> --><item><title>shown<!-- not this --></title></item>"),
    "prefixed": f'<a:feed xmlns:a="{ATOM}"><a:entry><a:title>p</a:title><a:link href="u"/><a:summary>s</a:summary><a:author><a:name>ann</a:name></a:author><a:published>2024</a:published></a:entry></a:feed>',
    "creator": RSS.format("<item><title>one</title><dc:creator>not the author</dc:creator><atom:link href='x'/></item>"),
    "cdata": RSS.format("<item><title><![CDATA[a < b & c]]></title><description><![CDATA[<p>x &amp; <i>y</i></p>]]></description><link> https://x.example/2 </link></item>"),
    "repeated": RSS.format("<item><title>first</title><title>second</title><link>1</link><link>2</link></item>"),
    "under the root": "<rss><item><title>no channel</title></item></rss>",
    "other namespace": '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><item><title>rdf</title></item></rdf:RDF>',
    "unknown prefix": RSS.format("<item><title>one</title><media:x>1</media:x></item>"),
    "unknown entity": RSS.format("<item><title>a&nbsp;b</title></item>"),
    "cut off": RSS.format("<item><title>one</title></item>")[:-20],
    "attributes": RSS.format('<item id="7"><title type="html">one</title><guid isPermaLink="false">g</guid></item>'),
    "empty elements": RSS.format("<item><title/><link></link><description/></item>"),
    "updated": f'<feed xmlns="{ATOM}"><entry><title> t </title><published></published><updated> 2024-05-06 </updated><author><name> bob </name></author></entry><entry/></feed>',
    "not xml": "hello",
    "blank": "   ",
    "empty": "",
}


def plain(xml):
    """Entries as the rule states them, by a parser of trees."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    text = lambda x, tag: (x.findtext(tag) or "").strip()

    def short(x):
        x = re.sub(r"<[^>]+>", "", x)
        for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
            x = x.replace(a, b)
        return " ".join(x.split())[:500]

    out = [(text(x, "title"), text(x, "link"), short(text(x, "description")), text(x, "author"), text(x, "pubDate")) for x in root.iter("item")]
    q = f"{{{ATOM}}}"
    for x in root.findall(f"{q}entry"):
        url = next((k.get("href") for k in x.findall(f"{q}link") if k.get("href")), "")
        author = x.find(f"{q}author")
        name = text(author, f"{q}name") if author is not None else ""
        out.append((text(x, f"{q}title"), url, short(text(x, f"{q}summary")), name, (x.findtext(f"{q}published") or x.findtext(f"{q}updated") or "").strip()))
    return out


@pytest.fixture(scope="module")
def read(spark):
    rows = feeds.read_feed_xml(spark.createDataFrame([*FEEDS.items(), ("null", None)], "source string, xml string")).collect()
    return {k: [tuple(r)[2:] for r in sorted(rows, key=lambda r: r.pos) if r.source == k] for k in [*FEEDS, "null"]}


@pytest.mark.parametrize("name", FEEDS)
def test_feed_agrees_with_a_tree_parser(read, name):
    assert read[name] == plain(FEEDS[name])


def test_null_feeds_give_nothing(read, spark):
    assert read["null"] == []
    assert feeds.read_feed_xml(spark.createDataFrame([], "source string, xml string")).count() == 0


def test_entries_without_a_namespace_count(spark):
    """A tree parser that asks for the namespace finds none; feeds that leave it out are read all the same."""
    xml = "<feed><entry><title>x</title><link href='u'/></entry></feed>"
    assert plain(xml) == []
    assert [tuple(r) for r in feeds.read_feed_xml(spark.createDataFrame([("s", xml)], "source string, xml string")).collect()] == [("s", 0, "x", "u", "", "", "")]
