"""Large JSON lists cut anywhere, and landed files of every kind read by name."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gistmill.sources import feeds, json_list, registry


def _objects(n, seed):
    rng = random.Random(seed)
    odd = ["{", "}", '"', "\\", "[", "]", ",", ":", "\n", "é", "知", "a", '\\"', "}{", '"}', " "]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    make = lambda: {text(): text(), "k": [{"x": text()}, {}, [text()]], "n": {"m": {"o": text()}}, "i": rng.randrange(9)}
    return [rng.choice([{}, make(), make(), {"long": text() * 40}]) for _ in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_lists_are_read_by_blocks(spark, tmp_path, indent):
    lists = {f"l{i}.json": _objects(n, i) for i, n in enumerate((0, 1, 7, 60))}
    for name, rows in lists.items():
        (tmp_path / name).write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = {}
            for r in json_list.read_objects(spark, str(tmp_path)).collect():
                found.setdefault(r["landed"].split("/")[-1], {})[r["pos"]] = json.loads(r["payload"], strict=False)
            for name, rows in lists.items():
                assert found.get(name, {}) == dict(enumerate(rows)), (name, size)
            assert set(found) <= set(lists)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_list_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"title": f"t{i}", "score": i / 2, "tags": ["{", str(i)], "content_fetched": i % 2 == 0} for i in range(300)]
    (tmp_path / "queue.json").write_text(json.dumps(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        one = sorted(map(str, feeds.read_candidate_queue(spark, str(tmp_path), document=True).collect()))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        assert json_list._chunks(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        assert sorted(map(str, feeds.read_candidate_queue(spark, str(tmp_path), document=True).collect())) == one
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(one) == 300 and any("t299" in r for r in one)


def test_cut_off_and_odd_members(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"b": "}"}, {"c": 3')
    (tmp_path / "odd.json").write_text('[1, {"a": 1}, null, [], {"b": 2}]\n')
    rows = json_list.read_objects(spark, str(tmp_path)).collect()
    assert sorted((r["landed"].split("/")[-1], r["pos"], r["payload"]) for r in rows) == [("cut.json", 0, '{"a": 1}'), ("cut.json", 1, '{"b": "}"}'), ("odd.json", 0, '{"a": 1}'), ("odd.json", 1, '{"b": 2}')]


PAYLOADS = {
    "feed_xml": ("量子位/1.xml", "<rss><channel><item><title>one</title><link>u1</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>", {"platform": "量子位", "url": "u1", "published": "2024-01-01"}),
    "hot_list": ("a.json", json.dumps({"data": [{"target": {"id": "5", "title": "AI 大模型 Agent 人工智能 创业 商业", "excerpt": "e", "vote_count": 3}}]}), {"platform": "知乎日报", "url": "https://www.zhihu.com/question/5"}),
    "video_search": ("a.json", json.dumps({"data": {"result": [{"title": "<em>AI</em> 大模型 Agent 人工智能 创业 商业", "bvid": "BV1"}]}}), {"platform": "bilibili", "url": "https://www.bilibili.com/video/BV1"}),
    "papers": ("a.json", json.dumps([{"id": "p1", "title": "t", "summary": "s", "authors": ["x"], "upvotes": 2}], indent=2), {"url": "https://huggingface.co/papers/p1", "author": "x"}),
    "repo_cards": ("a.html", '<h2 class="h3"> <a href="/own/llm-kit">x</a></h2><p class="color-fg-muted">d</p>', {"url": "https://github.com/own/llm-kit", "author": "own"}),
    "news_cards": ("a.html", '<a href="/news/1"><h3 class="item-title">AI 大模型 Agent 人工智能 创业 商业</h3></a>', {"url": "https://www.readaitime.com/news/1"}),
    "search_hits": ("some words/1.html", '<li class="news-list2"><h3><a href="w">t</a></h3><a class="account">acc</a></li>', {"url": "w", "author": "acc", "metadata": {"query": "some words"}}),
    "account_article": ("https%3A%2F%2Fx%2Fa+b.html", '<h1 class="rich_media_title">t</h1><div class="rich_media_content">body\nmore</div>', {"url": "https://x/a+b", "title": "t", "content": "body\nmore"}),
    "knowledge_list": ("inbox/1.json", json.dumps({"data": {"knowledge_list": [{"media_id": "m", "title": "t", "media_type": "1"}]}}), {"title": "t", "metadata": {"media_id": "m", "folder": "inbox", "media_type": "1"}}),
    "notes": ("库/n1.md", '---\ntags: ["x"]\n---\nbody', {"title": "n1", "url": "库/n1.md"}),
    "candidate_queue": ("q.json", '{"title": "a", "score": 2.5, "knowledge_id": "k"}\n\n{"title": "b"}\n', {"raw_score": 2.5, "title": "a"}),
}


def _land(root):
    for kind, (name, text, _) in PAYLOADS.items():
        path = root / kind / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return [(kind, str(root / kind)) for kind in PAYLOADS]


def test_every_kind_by_name(spark, tmp_path):
    landed = _land(tmp_path)
    assert set(registry.KINDS) == set(PAYLOADS)
    rows = registry.collect(spark, landed).orderBy("seq").collect()
    assert list(dict.fromkeys(r["kind"] for r in rows)) == list(PAYLOADS)
    assert len({r["seq"] for r in rows}) == len(rows)
    assert Counter(r["kind"] for r in rows) == {kind: 1 for kind in PAYLOADS} | {"candidate_queue": 2}
    first = {}
    for r in rows:
        first.setdefault(r["kind"], r.asDict())
    for kind, (_, _, want) in PAYLOADS.items():
        assert {k: first[kind][k] for k in want} == want, kind
    fewer = registry.collect(spark, landed, without={"notes", "papers"})
    assert {r["kind"] for r in fewer.select("kind").distinct().collect()} == set(PAYLOADS) - {"notes", "papers"}


def test_streams_give_what_batches_give(spark, tmp_path):
    _land(tmp_path / "in")
    for kind in ("feed_xml", "hot_list", "account_article", "candidate_queue"):
        path, sink = str(tmp_path / "in" / kind), str(tmp_path / "out" / kind)
        run = lambda: registry.stream_landed(spark, kind, path).writeStream.option("checkpointLocation", sink + "-state").trigger(availableNow=True).start(sink, "parquet").awaitTermination()  # noqa: E731, B023
        run()
        run()  # a restart reads no file again
        rows = lambda df: sorted(map(str, df.withColumn("metadata", F.map_entries("metadata")).collect()))
        batch = registry.read_landed(spark, kind, path)
        assert rows(spark.read.parquet(sink)) == rows(batch) != [], kind


def test_kinds_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="no kind"):
        registry.read_landed(spark, "other", str(tmp_path))
    with pytest.raises(ValueError, match="already"):
        registry.register("notes", registry.KINDS["notes"])
    with pytest.raises(ValueError, match="no stream"):
        registry.stream_landed(spark, "notes", str(tmp_path))
    with pytest.raises(ValueError, match="no source"):
        registry.collect(spark, [("notes", str(tmp_path))], without=["notes"])
