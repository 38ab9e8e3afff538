"""Table operators on small tables, with brute-force counterparts where there is a rule to follow."""

import random
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gistmill import shared
from gistmill.functions import classify, interpret, scoring, text
from gistmill.operators import dedup, digest, links, report, select
from gistmill.sources import feeds
from gistmill.streaming import items as stream


def articles(spark, rows):
    return spark.createDataFrame(rows, "seq long, title string, url string, raw_score double, platform string, category string")


def test_dedup_urls_keeps_first_and_one_empty(spark):
    rows = articles(spark, [(1, "a", "u", 1.0, "p", "c"), (2, "b", "u", 9.0, "p", "c"), (3, "c", "", 1.0, "p", "c"), (4, "d", None, 1.0, "p", "c")])
    assert sorted(r.seq for r in dedup.dedup_urls(rows).collect()) == [1, 3]


def greedy(rows, threshold):
    kept = []
    for seq, title, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        if all(SequenceMatcher(None, title, t).ratio() < threshold for _, t in kept):
            kept.append((seq, title))
    return sorted(s for s, _ in kept)


@pytest.mark.parametrize("seed", range(3))
def test_dedup_titles_is_the_greedy_pass(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcde", k=rng.randint(4, 12))) for _ in range(8)]
    rows = [(i, "".join(c if rng.random() > 0.15 else rng.choice("abcde") for c in rng.choice(base)), float(rng.randint(1, 5))) for i in range(60)] + [(100, "", 1.0), (101, "", 2.0)]
    df = articles(spark, [(i, t, "", s, "p", "c") for i, t, s in rows])
    assert sorted(r.seq for r in dedup.dedup_titles(df).collect()) == greedy(rows, 0.75)


def test_top_titles_are_those_of_the_whole_table(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(6)]
    rows = [(i, "".join(c if rng.random() > 0.1 else rng.choice("abcde") for c in rng.choice(base)), float(rng.randint(1, 9))) for i in range(80)]
    df = articles(spark, [(i, t, "", s, "p", "c") for i, t, s in rows])
    kept = set(greedy(rows, 0.75))
    want = [i for i, _, _ in sorted(rows, key=lambda r: (-r[2], r[0])) if i in kept]
    for n in (3, 500):
        got = dedup.top_titles(df, n).orderBy(F.desc("raw_score"), "seq").collect()
        assert [r.seq for r in got] == want[:n]
    options = digest.Options().with_overrides({"top_n": 2, "min_score": 5.0, "category_weights": {"c": 0.5}})
    assert digest.digest_articles(df, options).count() == 0
    ranked = digest.digest_articles(df, digest.Options(top_n=2, min_score=0.0, category_default=1.0)).collect()
    assert sorted((r["rank"], r.seq) for r in ranked) == [(1, want[0]), (2, want[1])]
    with pytest.raises(TypeError):
        digest.Options().with_overrides({"unknown": 1})


def test_dedup_titles_chain_keeps_both_ends(spark):
    chain = [(1, "abcdefgh", 3.0), (2, "abcdefxy", 2.0), (3, "abqrefxy", 1.0)]
    df = articles(spark, [(i, t, "", s, "p", "c") for i, t, s in chain])
    assert sorted(r.seq for r in dedup.dedup_titles(df).collect()) == greedy(chain, 0.75) == [1, 3]


def test_empty_tables(spark):
    none = articles(spark, [])
    assert dedup.dedup_titles(none).count() == dedup.dedup_urls(none).count() == select.source_counts(none).count() == 0
    assert [r.n for r in select.score_distribution(none).collect()] == [0] * 5
    assert select.normalize_scores(none).count() == 0


def test_normalize(spark):
    score = lambda xs: [r.raw_score for r in select.normalize_scores(articles(spark, [(i, "t", "", x, "p", "c") for i, x in enumerate(xs)])).orderBy("seq").collect()]
    assert score([2.0, 2.0]) == [3.0, 3.0] and score([0.0, 5.0, 10.0]) == [1.0, 3.0, 5.0]


def test_ties_keep_collection_order(spark):
    top = select.top_articles(articles(spark, [(i, "t", "", 1.0, "p", "c") for i in (5, 3, 4)]), 2)
    assert [r.seq for r in top.collect()] == [3, 4]


def test_sections_top_up(spark):
    rows = [(0, 5.0, True)] + [(i, 3.0, i != 2) for i in range(1, 5)]
    got = select.select_digest_sections(spark.createDataFrame(rows, "seq long, score double, interpretable boolean")).collect()
    assert sorted(r.seq for r in got if r.section == "deep") == [0, 1, 3]
    assert sorted(r.seq for r in got if r.section == "brief") == [1, 2, 3, 4]


def test_versions(spark):
    cands = spark.createDataFrame([(i, "a/b.md") for i in range(3)], "seq long, rel_path string")
    held = spark.createDataFrame([("a/b.md",)], "rel_path string")
    assert [r.final_path for r in links.version_paths(cands, held).orderBy("seq").collect()] == ["a/b_v2.md", "a/b_v3.md", "a/b_v4.md"]


def test_versions_of_a_hot_path(spark):
    """Ranks are limited before the shuffle, so no task gets all candidates of a path."""
    cands = spark.range(0, 20000, 1, 8).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "a/c.md").otherwise("a/b.md").alias("rel_path"))
    held = spark.createDataFrame([("a/b.md",), ("a/b_v3.md",), ("a/c_v2.md",)], "rel_path string")
    got = links.version_paths(cands, held)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    free = {"a/b": iter(["_v2", *[f"_v{v}" for v in range(4, 100)]]), "a/c": iter(["", *[f"_v{v}" for v in range(3, 100)]])}
    want = []
    for seq in range(20000):
        stem = "a/c" if seq % 3 == 0 else "a/b"
        want.append((seq, stem + next(free[stem], "") + ".md"))
    assert sorted((r.seq, r.final_path) for r in got.collect()) == want


def test_index_entries(spark):
    schema = "seq long, index_key string, rel_path string, title string"
    cands = spark.createDataFrame([(1, "k", "p1.md", "t1"), (2, "k", "p2.md", "t2"), (3, "k", "p3.md", "t2"), (4, "j", "p1.md", "t1")], schema)
    index = spark.createDataFrame([(0, "k", "p1.md", "x")], schema)
    got = links.append_index_entries(cands, index, F.lit("2026-07-21").cast("date")).collect()
    assert sorted((r.seq, r.entry) for r in got) == [(2, "- [2026-07-21] [[p2|t2]]"), (4, "- [2026-07-21] [[p1|t1]]")]


def test_new_items(spark):
    schema = "seq long, media_id string, folder_id string"
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None), (4, "c", "folder"), (5, None, None)], schema)
    seen = spark.createDataFrame([("b",)], "media_id string")
    assert [(r.seq, r.media_id) for r in links.new_items(rows, seen).collect()] == [(1, "a")]


def brute_links(cands, notes, k=8):
    out = set()
    for seq, terms, tags, domain, subs in cands:
        scored = []
        for path, title, nterms, ntags in notes:
            s = 3 * len(terms & nterms) + 2 * len(tags & ntags) + 5 * (domain in path) + 4 * any(x in title or x in path for x in subs)
            if s > 0:
                scored.append((-s, path))
        out |= {(seq, p, -s) for s, p in sorted(scored)[:k]}
    return out


def test_suggest_links_is_exact(spark):
    rng = random.Random(1)
    words, tags = ["alpha", "beta", "gamma", "delta", "omega"], ["t1", "t2", "t3"]
    domains, subs = ["AI与智能体", "商业与管理"], ["大模型", "AIGC", "战略管理"]
    notes, rows = [], []
    for i in range(60):
        title = " ".join(rng.sample(words, rng.randint(0, 2))) + f" {i}" + (rng.choice(subs) if rng.random() < 0.3 else "")
        path = f"base/{rng.choice(domains)}/{i:03d}.md"
        nt = rng.sample(tags, rng.randint(0, 2))
        rows.append((title, path, nt))
    cands = [(s, " ".join(rng.sample(words, 1)), rng.sample(tags, 1), rng.choice(domains), rng.sample(subs, rng.randint(0, 2))) for s in range(6)]
    ndf = spark.createDataFrame(rows, "title string, rel_path string, tags array<string>")
    cdf = spark.createDataFrame(cands, "seq long, title string, tags array<string>, domain_name string, subdomains array<string>")
    from gistmill.functions.text import tokenize_ngrams

    terms = {r.rel_path: set(r.x) for r in ndf.select("rel_path", tokenize_ngrams(F.col("title")).alias("x")).collect()}
    notes = [(p, t, terms[p], set(g)) for t, p, g in rows]
    want = brute_links([(s, {t}, set(g), d, x) for s, t, g, d, x in cands], notes)
    assert {(r.seq, r.rel_path, r.score) for r in links.suggest_links(cdf, ndf).collect()} == want


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_suggest_links_with_a_term_in_every_note(spark, hot):
    """Any bound for hot keys gives the links of a plain walk; with one, pairs grow with k and not with the notes."""
    rng = random.Random(hot)
    words = ["alpha", "beta", "gamma", "delta"]
    subs = ["大模型", "AIGC"]
    notes = [(f"common {' '.join(rng.sample(words, rng.randint(0, 2)))} only{i}", f"base/{rng.choice(['AI与智能体', '商业与管理'])}/{rng.choice(['', *subs])}{i % 150:03d}.md", [rng.choice(["t1", "t2", None]) for _ in range(2)]) for i in range(200)]
    notes.append((None, "base/none.md", None))
    cands = [(s, f"common {rng.choice(words)} only{s}", ["t1"] if s % 2 else None, rng.choice(["AI与智能体", None]), rng.sample(subs, s % 3)) for s in range(12)]
    cands.append((12, "common", None, None, None))
    cands.append((13, None, None, None, None))
    ndf = spark.createDataFrame(notes, "title string, rel_path string, tags array<string>")
    cdf = spark.createDataFrame(cands, "seq long, title string, tags array<string>, domain_name string, subdomains array<string>")
    from gistmill.functions.text import tokenize_ngrams

    cut = {r.title: set(r.x or []) for r in ndf.unionByName(cdf.select("title", F.lit("").alias("rel_path"), "tags")).select("title", tokenize_ngrams(F.col("title")).alias("x")).collect()}
    want = []
    for seq, title, tags, domain, named in cands:
        rated = []
        for t, path, g in notes:
            n, m = len(cut[title] & cut[t]), len((set(tags or []) & set(g or [])) - {None})
            s = 3 * n + 2 * m + 5 * bool(domain and domain in path) + 4 * any(x in (t or "") or x in path for x in named or [])
            if s:
                rated.append((-s, path, n, m))
        want += [(seq, s, path) for s, path, *_ in sorted(rated)[:8]]
    got = [(r.seq, -r.score, r.rel_path) for r in links.suggest_links(cdf, ndf, 8, hot).collect()]
    assert sorted(got) == sorted(want)
    keyed = lambda df, *c: df.select(*c, F.transform(tokenize_ngrams(F.col("title")), lambda x: F.concat(F.lit("t"), x)).alias("keys"))
    pairs = links.link_pairs(keyed(cdf, "seq"), keyed(ndf.withColumn("nid", F.monotonically_increasing_id()), "nid", "rel_path"), 8, hot).count()
    assert pairs <= len(cands) * (8 + 5 * hot)


class Blocks(HTMLParser):
    """Blocks of a page by a parser: text and how many of its characters are out of links."""

    unread, ends = {"script", "style", "head"}, {"p", "div", "li", "ul", "nav", "h1", "article", "br", "body", "html", "td", "tr", "table"}

    def __init__(self, page):
        super().__init__()
        self.rows, self.skip, self.link = [["", 0]], 0, False
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.unread
        self.link |= tag == "a"
        if tag in self.ends:
            self.rows.append(["", 0])

    def handle_endtag(self, tag):
        self.skip -= tag in self.unread
        self.link &= tag != "a"
        if tag in self.ends:
            self.rows.append(["", 0])

    def handle_data(self, data):
        if not self.skip:
            self.rows[-1][0] += data
            self.rows[-1][1] += 0 if self.link else len("".join(data.split()))


def plain_dense(page):
    rows = [(" ".join(t.split()), len("".join(t.split())), f) for t, f in Blocks(page).rows if t.strip()]
    weights = [0, *[f if 3 * (n - f) <= n else 0 for _, n, f in rows], 0]
    body = "\n".join(r[0] for i, r in enumerate(rows, 1) if weights[i] and weights[i - 1] + 2 * weights[i] + weights[i + 1] >= 160)
    return body if len(body) > 200 else None


def test_dense_body(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["融资", "model", "的", "of", "agents", "a &amp; b", "<b>bold</b>", "\n"]) for _ in range(n))
    link = lambda n: f'<A href="/x?a=1">{say(n)}</A>'
    make = [lambda: f"<p>{say(rng.randint(0, 60))}</p>", lambda: f"<ul>{''.join(f'<li>{link(2)}</li>' for _ in range(4))}</ul>", lambda: f"<div class='x'>{say(3)}<br/>{say(20)}{link(rng.randint(1, 15))}</div>", lambda: "<script>var t = '</p>' + 'long text '.repeat(99)</script>", lambda: "<!-- <p>hidden</p> -->", lambda: f"<h1>{say(4)}</h1>"]
    pages = [f"<html><head><title>{say(40)}</title><style>p{{}}</style></head><body>{''.join(rng.choice(make)() for _ in range(rng.randint(0, 14)))}</body></html>" for _ in range(150)]
    pages += ["", "plain " * 60, "<p>" + "x" * 300, None]
    got = spark.createDataFrame(list(enumerate(pages)), "i int, page string").select("i", text.extract_dense_body(F.col("page")).alias("t")).collect()
    want = {i: p and plain_dense(p) for i, p in enumerate(pages)}
    assert {r.i: r.t for r in got} == {i: t or None for i, t in want.items()}
    assert 30 < sum(t is not None and len(t) > 0 for t in want.values() if t) < 150


def test_full_text_takes_dense_blocks_first(spark):
    long, other = "dense words of the article " * 12, "container words, one link each "
    page = f'<p>{long}</p><ul><li><a href="x">menu</a></li></ul><div class="article-body">{"".join(f"<b>{other}</b><a>{other}</a>" for _ in range(9))}</div>'
    rows = spark.createDataFrame([(page, "少数派"), (page.replace(long, "short"), "少数派"), ("<p>x</p>", "少数派")], "page string, platform string")
    got = [tuple(r) for r in rows.select(text.full_article_text(F.col("page"), F.col("platform"), dense=True), text.full_article_text(F.col("page"), F.col("platform"))).collect()]
    assert got[0][0] == long.strip() and got[0][1].startswith(other) and got[1][0] == got[1][1] and got[1][0].startswith(other) and got[2] == (None, None)


def test_feeds(spark):
    rss = "<rss><channel><item><title>T&amp;1</title><link>u1</link><description>&lt;b&gt;hi&lt;/b&gt;</description><pubDate>Tue, 21 Jul 2026 08:00:00 GMT</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>T2</title><link href="u2"/><summary>s</summary><author><name>n</name></author><updated>2026-07-20</updated></entry></feed>'
    raw = spark.createDataFrame([("a", rss), ("b", atom), ("c", "<rss><item>"), ("d", None)], "source string, xml string")
    got = {r.source: r for r in feeds.read_feed_xml(raw).collect()}
    assert set(got) == {"a", "b"} and got["a"].title == "T&1" and got["b"].url == "u2" and got["b"].author == "n"
    sources = spark.createDataFrame([("a", "A", "direct", "AI技术", "d")], "key string, name string, type string, category string, descr string")
    rows = {r.platform: r for r in feeds.normalize_feed_entries(feeds.read_feed_xml(raw), sources).collect()}
    assert rows["a"].published == "2026-07-21" and rows["a"].category == "AI技术" and rows["b"].category is None


def test_listings(spark):
    def raw(x):
        return spark.createDataFrame([(x,)], "payload string")

    hot = feeds.read_hot_list_json(raw('{"data":[{"target":{"id":"7","title":"AI 融资与上市","excerpt":"","detail_count":100,"author":{"name":"x"}}},{"target":{"title":""}}]}')).collect()
    assert len(hot) == 1 and hot[0].url.endswith("/7") and hot[0].raw_score == 13.0
    video = feeds.read_video_search_json(raw('{"data":{"result":[{"title":"<em class=\\"keyword\\">AI</em>融资","bvid":"b","stat":{"view":100,"favorite":2,"danmaku":0}}]}}')).collect()
    assert video[0].title == "AI融资" and video[0].raw_score == 13.0
    papers = feeds.read_papers_json(raw('{"papers":[{"id":"1","title":"t","summary":"s","authors":["a","b","c","d"],"upvotes":3}]}')).collect()
    assert papers[0].author == "a, b, c" and papers[0].category == "AI技术" and papers[0].raw_score == 3.0
    assert feeds.read_papers_json(raw("not json")).collect() == []
    page = spark.createDataFrame([('<h2 class="h"><a href="/o/llm-x">o / llm-x</a></h2><p class="color-fg-muted"> a gpt tool </p><span itemprop="programmingLanguage">Python</span>',)], "html string")
    card = feeds.extract_repo_cards(page).collect()
    assert card[0].title == "o/llm-x: a gpt tool" and card[0].summary == "a gpt tool [Python]"
    news = spark.createDataFrame([('<article class="digest-item"><a href="/news/1"><header><h3 class="item-title">AI融资新闻</h3></header><p class="item-summary">上市</p>',)], "html string")
    assert [r.url for r in feeds.extract_news_cards(news).collect()] == ["https://www.readaitime.com/news/1"]
    hits = spark.createDataFrame([("q", '<li class="news-list2"><h3><a href="u">t</a></h3><p class="txt-info">s  s</p><a class="account">acc</a></li><li class="news-list2">x</li>')], "query string, html string")
    assert [tuple(r) for r in feeds.extract_search_hits(hits).collect()] == [("q", 0, "t", "u", "s s", "acc")]
    page = spark.createDataFrame([("u", '<h1 class="rich_media_title">T</h1><a id="js_name">N</a><div class="rich_media_content">a<br>b</div>')], "url string, html string")
    assert tuple(feeds.extract_account_article(page).first())[1:4] == ("T", "N", "a\nb")
    listing = spark.createDataFrame([("f", '{"data":{"knowledge_list":[{"media_id":"m1","title":"x"},{"media_id":"m2","folder_id":"d"}]}}')], "folder string, payload string")
    assert [r.media_id for r in feeds.read_knowledge_list(listing).collect()] == ["m1"]


def test_notes_and_queue(spark, tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb/a.md").write_text('---\ntags: ["x", y]\n---\nbody')
    (tmp_path / "kb/a_v2.md").write_text("plain")
    (tmp_path / "kb/_moc.md").write_text("index")
    got = feeds.read_notes(spark, str(tmp_path / "kb")).collect()
    assert [(r.title, r.stem, r.tags) for r in got] == [("a", "a_v2", [])]
    queue = spark.createDataFrame([("t", "u", "内容", "解读")], "title string, url string, full_content string, interpretation string")
    feeds.write_candidate_queue(queue, str(tmp_path / "queue"))
    back = feeds.read_candidate_queue(spark, str(tmp_path / "queue")).first()
    assert (back.title, back.full_content_len, back.interpretation, back.platform) == ("t", 2, "解读", "")


def test_queue_documents(spark, tmp_path):
    (tmp_path / "queue.json").write_text('[{"title": "t", "url": "u", "tags": ["x"]}, {"title": "v", "url": "w", "score": 2.5}]')
    rows = {r.title: r for r in feeds.read_candidate_queue(spark, str(tmp_path / "queue.json"), document=True).collect()}
    assert (rows["t"].tags, rows["t"].score, rows["t"].prompt) == (["x"], 0.0, "") and (rows["v"].tags, rows["v"].score) == ([], 2.5)


def test_digests_of_a_day_are_replaced(spark, tmp_path):
    day = lambda body: spark.createDataFrame([("a.md", body)], "rel_path string, body string")
    for body, when in (("one", "2026-07-20"), ("two", "2026-07-21"), ("three", "2026-07-21")):
        report.write_notes(day(body), str(tmp_path / "out"), when)
    assert {(str(r.run_date), r.body) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("2026-07-20", "one"), ("2026-07-21", "three")}


def test_joins_by_size(spark):
    one, two = spark.range(50).withColumn("x", F.lit("é" * 100)), spark.range(50)
    assert shared.small(one) and not shared.small(one, 50 * 200)
    for limit in (0, 1 << 20):
        assert shared.sized_join(two, one, "id", "inner", limit).count() == 50
    nested = spark.createDataFrame([([("a" * 500, 1)], None)], "a array<struct<s:string,i:int>>, b string")
    assert not shared.small(nested, 500) and shared.small(nested, 2000)


def test_own_extractor_and_rule_tables(spark):
    page = "<script>no</script><!-- no --><p>one &amp;amp; two</p>\n\n\n <b>three</b>  four " + "字" * 100
    one = spark.range(1).select(text.extract_text_simple(F.lit(page)).alias("a"), text.extract_text_simple(F.lit("<p>short</p>")).alias("b"), text.extract_text_simple(F.lit(None).cast("string")).alias("c"), text.extract_text_simple(F.lit("x" * 9000)).alias("d")).first()
    assert one.a == "one &amp; two\nthree four " + "字" * 100 and one.b is None and one.c is None and len(one.d) == 8000
    field = '{"content": "' + "<p>甲\\n乙</p>" + '", "excerpt": ""}'
    got = spark.range(1).select(text.extract_site_body(F.lit(field), F.lit("知乎")).alias("x"), text.extract_site_body(F.lit('<div class="RichContent-inner">丙</div>'), F.lit("知乎")).alias("y")).first()
    assert (got.x, got.y) == ("甲\n乙", "丙")
    rated = spark.range(1).select(
        classify.topic_classify(F.lit("foo bar"), F.lit(""), [("A", ["foo"]), ("B", ["foo", "bar"])], "none").alias("t"),
        scoring.interest_classify(F.lit("AI bar"), F.lit(""), [("X", 2.0, ["bar"])]).alias("i"),
        interpret.insight_rank(F.array(F.lit("a"), F.lit("b"))).alias("r"),
        interpret.best_sentence(F.array(F.lit("a"))).alias("s"),
    ).first()
    assert (rated.t, rated.i.category, rated.i.score, rated.r, rated.s) == ("B", "X", 2.5, [], None)


def test_full_text_and_links(spark):
    body = "<article>" + "字" * 300 + "</article>"
    arts = spark.createDataFrame([(1, "量子位", "u1", "短"), (2, "量子位", "", "短"), (3, "量子位", "u1", "长" * 600)], "seq long, platform string, url string, content string")
    pages = spark.createDataFrame([("u1", body, 200), ("u2", body, 500)], "url string, html string, status int")
    got = {r.seq: len(r.content) for r in links.attach_full_text(arts, pages).collect()}
    assert got == {1: 300, 2: 1, 3: 600}
    top = spark.createDataFrame([(1, "u1", "别的"), (2, "u3", ""), (3, "", ""), (4, "https://zhihu.com/x", "")], "rank int, url string, summary string")
    checked = links.repair_summaries(links.check_links(top, pages), pages)
    assert {r["rank"]: (r.link, r.fixed) for r in checked.collect()} == {1: ("ok", True), 2: ("dead", False), 3: ("skipped", False), 4: ("skipped", False)}
    assert tuple(links.check_summary(checked).first()) == (2, 1, 1)


def test_digest_text(spark):
    ranked = select.rank_articles(articles(spark, [(1, "A", "u", 8.0, "虎嗅", "c"), (2, "B", "u", 2.0, "x", "")]).withColumn("summary", F.lit("s")))
    body = report.render_digest(ranked, F.lit("2026-07-21").cast("date")).first().body
    assert "### 1. A  ★★★★★" in body and "(周二)" in body and "2026-07-22 07:00" in body
    assert {r.category for r in report.render_digest_grouped(ranked).collect()} == {"c", "其他"}


def test_streams(spark, tmp_path):
    schema = "seq long, media_id string, folder_id string, ts timestamp, content string, summary string, title string"
    for i, rows in enumerate([[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]]):
        spark.createDataFrame([(s, m, None, None, "框架", None, None) for s, m in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    source = stream.read_items(spark, str(tmp_path / "in"), schema)
    q = stream.stream_new_items(source).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.media_id for r in spark.table("fresh").collect()) == ["a", "b", "c"]
    done = stream.stream_digest_batches(stream.stream_score(source), lambda b: b.groupBy("level").count(), str(tmp_path / "out"), str(tmp_path / "c2"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 5
