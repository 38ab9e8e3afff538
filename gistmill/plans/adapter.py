"""The test tables as articles, notes, items and answers, in Spark and as SQL.

The tables hold no Chinese text, so headlines, figures and a block of prose are mixed in by
fixed rules on the row's id; the SQL states the same rules for DuckDB.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime.date(2026, 7, 21)
PLATFORMS = ["36氪", "虎嗅", "量子位", "爱范儿", "少数派", "知乎日报", "机器之心", "github", "huggingface", "晚点LatePost"]
CATEGORIES = ["AI技术", "投资分析", "经济趋势", "产业研究", "综合"]
HEADLINES = [
    "", "独家：大模型公司完成新一轮融资", "AI Agent 正在改变工作流", "深度 | 机器人赛道的竞争格局", "OpenAI 发布新的推理模型", "今天天气不错", "首发评测：DeepSeek 开源模型上手", "具身智能公司专访与复盘", "从芯片到算力的长跑",
    "WAIC 大会观察：多模态落地", "知识管理的方法论与框架", "短剧出海与 AIGC 视频生成", "云计算降价，谁在受益", "一份万字报告：企业数字化转型", "Claude 与 Copilot 的产品对比", "广告：扫码领取课程优惠", "量化与微调：显存够用吗", "RAG 与向量数据库实践指南", "人形机器人开放公测", "刷屏的智能体到底是什么",
    "NeurIPS 最佳论文解读", "投资人对话：估值与利润", "效率工具 Obsidian 笔记教程", "自动驾驶数据闭环", "苹果发布会前瞻", "A股上市公司财报盘点", "SaaS 订阅与用户增长", "GPU 短缺背后的供应链", "内容创作者的新工具", "Transformer 之后的架构", "AI",
]
LEADS = [
    "", "该公司完成3亿美元融资，估值增长50%。", "专家认为这是第一次大规模应用。", "2026年市场规模将达到120亿，同比增长3倍。", "某某科技与云端智能达成合作，", "1. 背景 2. 数据 3. 结论：", "没有关键信息。", "营收5000万元，利润率12%，", "星河机器人发布新品，", "观点：模型压缩与推理加速是核心。", "关注公众号回复领取红包。",
    "平台用户增长2倍，", "数字经济与电商直播，", "编程助手与代码生成工具上手体验。", "Midjourney 与 Sora 对比，", "战略合作签约，", "教程：如何使用低代码平台。", "行业分析与商业模式拆解，", "PyTorch 源码与 embedding 教程，", "", "融资500万，", "第二届大会召开，", "AI工具推荐：",
]
BLOCK = (
    "# 智能体的工程实践\n\n## 背景\n\n真正的变化不在于模型参数的增加，而在于组织流程的重新设计和团队协作方式的转变。\n\n这家公司提出了三层飞轮模型，并且构建了一套“数据驱动增长框架”。\n\n"
    "## 方法\n\n与其追求更大的模型，不如先把工作流和知识管理做好，这意味着效率提升才是关键所在！业内常说的「智能体协作框架」就是一个案例。\n\n"
    "function run() {\n  return {\n}\nconst answer = 42;\nRead more\n\n\n\n"
    "## 步骤\n\n团队总结出五个阶段的落地方法论，每个阶段都应该有清晰的目标与数据指标，例如增长30%。\n\n但是多数企业并不缺少工具，缺少的其实是把工具用起来的管理能力和持续复盘的习惯。\n\n"
    "## 总结\n\n从经验驱动到数据驱动的转型需要时间，建议先从一个小的应用场景开始尝试，再逐步推广到整个组织。\n\n相比之下，单纯购买软件并不能解决根本问题，最重要的是让一线员工参与设计和改进流程。\n\n"
)

_PICK = "list_value({})[(doc_id % {}) + 1]"


def _pick(values: list[str], column: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _sql_pick(values: list[str]) -> str:
    return _PICK.format(", ".join(map(quoted, values)), len(values))


def articles(spark: SparkSession, sf_dir: str, urls: bool = False) -> DataFrame:
    """Every document as an article; with ``urls`` also the url of a page, or an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seq = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    # Only as much of the text as makes 300 characters is collapsed: each is a run of blanks or one other.
    start = F.regexp_extract(text, r"^(?:[ \t\n\r\f]++|[^ \t\n\r\f]){0,300}+", 0)
    day = F.date_format(F.date_sub(F.lit(NOW), (seq % 20).cast("int")), "yyyy-MM-dd")
    published = F.when(seq % 23 == 1, "").when(seq % 23 == 2, "not a date").when(seq % 23 == 3, "Tue, 21 Jul 2026 08:00:00 GMT").otherwise(day)
    rows = docs.select(
        seq.alias("seq"),
        _pick(PLATFORMS, seq).alias("platform"),
        F.concat(_pick(HEADLINES, seq), F.substring(F.substring_index(text, "\n", 1), 1, 60)).alias("title"),
        F.concat(_pick(LEADS, seq), F.regexp_replace(start, r"[ \t\n\r\f]+", " ")).alias("summary"),
        F.concat(F.when(seq % 7 == 0, BLOCK).otherwise(""), text).alias("content"),
        _pick(CATEGORIES, seq).alias("category"),
        published.alias("published"),
        F.col("lang").alias("author"),
    )
    if not urls:
        return rows
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = rows.withColumn("page_id", F.when(F.col("seq") % 50 == 49, -1).otherwise(F.col("seq") % max(pages.count(), 1)))
    return rows.join(pages.select("page_id", "url"), "page_id", "left").withColumn("url", F.coalesce("url", F.lit(""))).drop("page_id")


ARTICLES_SQL = f"""articles AS (
  SELECT d.seq, d.platform, d.title, d.summary, d.content, d.category, d.published, d.author, coalesce(p.url, '') AS url
  FROM (SELECT doc_id AS seq, {_sql_pick(PLATFORMS)} AS platform,
      {_sql_pick(HEADLINES)} || substr(split_part(coalesce(text, ''), chr(10), 1), 1, 60) AS title,
      {_sql_pick(LEADS)} || substr(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f]+', ' ', 'g'), 1, 300) AS summary,
      CASE WHEN doc_id % 7 = 0 THEN {quoted(BLOCK)} ELSE '' END || coalesce(text, '') AS content,
      {_sql_pick(CATEGORIES)} AS category,
      CASE doc_id % 23 WHEN 1 THEN '' WHEN 2 THEN 'not a date' WHEN 3 THEN 'Tue, 21 Jul 2026 08:00:00 GMT'
        ELSE strftime(DATE '{NOW}' - CAST(doc_id % 20 AS INTEGER), '%Y-%m-%d') END AS published,
      lang AS author,
      CASE WHEN doc_id % 50 = 49 THEN -1 ELSE doc_id % (SELECT greatest(count(*), 1) FROM pages) END AS page_id
    FROM documents) d LEFT JOIN pages p USING (page_id))"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as notes in folders of the five domains."""
    from gistmill import rules

    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    i = F.col("item_id")
    title = F.concat(_pick(HEADLINES, i * 3 + 1), F.lit(" "), i.cast("string"))
    tags = F.array(_pick(rules.ENTITIES, i), _pick(PLATFORMS, i), _pick(["案例", "动态", "方法"], i))
    return rows.select(i.alias("item_id"), title.alias("title"), F.concat(F.lit("02-专业知识库/"), _pick([d for d, _ in rules.DOMAINS], i), F.lit("/"), title, F.lit(".md")).alias("rel_path"), tags.alias("tags"), F.col("text").alias("body"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items of a listing: ids repeat, and some rows are folders."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_id").alias("seq"), F.concat(F.lit("m"), (F.col("event_id") % 700).cast("string")).alias("media_id"), F.when(F.col("event_id") % 10 == 0, F.col("event_type")).alias("folder_id"), F.col("event_type").alias("title"), "ts", "props")


ITEMS_SQL = "items AS (SELECT event_id AS seq, 'm' || CAST(event_id % 700 AS VARCHAR) AS media_id, CASE WHEN event_id % 10 = 0 THEN event_type END AS folder_id, event_type AS title, ts FROM events)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, whole, as answers with sections; category, frameworks and takeaways vary with the row."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    said = F.coalesce("text", F.lit(""))
    k = F.col("conv_id") + F.col("turn")
    text = F.concat(
        F.lit("【核心论点】\n"), F.substring_index(said, "\n", 1),
        F.lit("\n【主题分类】\n"), _pick(TOPIC_LINES, k),
        F.lit("\n【关键框架】\n- "), _pick(FRAMEWORK_LINES, k),
        F.lit("\n【洞察要点】\n1. 六个字以上的句子\n"), said,
        F.lit("\n【数据看点】\n无关键数据\n【行动启发】\n- "), _pick(ACTION_LINES, k), F.lit("\n"),
    )
    return rows.select("conv_id", "turn", text.alias("answer"))


TOPIC_LINES = ["AI Agent与工程", "商业与管理观察", "无", "短"]
FRAMEWORK_LINES = ["无", "数据驱动增长框架\n- 三层飞轮模型方法", "暂无"]
ACTION_LINES = ["先从一个小场景开始", "略", "每周复盘一次结果\n2. 再逐步推广到整个组织", "无", "写下三条能做的事"]
ANSWERS_SQL = f"""answers AS (SELECT conv_id, turn, coalesce(text, '') AS said, split_part(coalesce(text, ''), chr(10), 1) AS one,
  {_sql_pick(TOPIC_LINES).replace("doc_id", "(conv_id + turn)")} AS topic, {_sql_pick(FRAMEWORK_LINES).replace("doc_id", "(conv_id + turn)")} AS frame, {_sql_pick(ACTION_LINES).replace("doc_id", "(conv_id + turn)")} AS act
  FROM conversations WHERE role = 'assistant')"""


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten articles each as a landed feed ``source, xml``: RSS, or Atom for every third, every second of those with a prefix; one feed in eleven is cut off."""
    rows = articles(spark, sf_dir, urls=True).select("seq", _xml(F.col("title")).alias("t"), _xml(F.col("url")).alias("u"), _xml(F.col("summary")).alias("s"), F.coalesce("author", F.lit("")).alias("a"), "published")
    feed = F.floor(F.col("seq") / 10)
    mark = F.when(feed % 2 == 0, "a:").otherwise("")
    tag = lambda name, c, p=F.lit(""): F.concat(F.lit("<"), p, F.lit(f"{name}>"), c, F.lit("</"), p, F.lit(f"{name}>"))
    rss = F.concat(F.lit("<item\n>"), tag("title", F.col("t")), tag("link", F.col("u")), tag("description", F.col("s")), tag("author", F.col("a")), F.lit("<dc:creator>nobody</dc:creator><!-- <item><title>none</title></item> -->"), tag("pubDate", F.col("published")), F.lit("</item>"))
    link = F.concat(F.lit("<"), mark, F.lit("link rel='self' href=''/><"), mark, F.lit("link href='"), F.replace("u", F.lit("'"), F.lit("&apos;")), F.lit("'/>"))
    atom = tag("entry", F.concat(tag("title", F.col("t"), mark), link, tag("summary", F.col("s"), mark), tag("author", tag("name", F.col("a"), mark), mark), tag("updated", F.col("published"), mark)), mark)
    entries = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.when(feed % 3 == 2, atom).otherwise(rss).alias("x")))), lambda e: e["x"]), "")
    files = rows.groupBy(feed.alias("feed")).agg(entries.alias("x"))
    ns = F.lit(' xmlns="http://www.w3.org/2005/Atom">'), F.lit(' xmlns:a="http://www.w3.org/2005/Atom">')
    whole = F.when(F.col("feed") % 3 == 2, F.when(F.col("feed") % 2 == 0, F.concat(F.lit("<a:feed"), ns[1], "x", F.lit("</a:feed>"))).otherwise(F.concat(F.lit("<feed"), ns[0], "x", F.lit("</feed>"))))
    whole = F.coalesce(whole, F.concat(F.lit('<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>'), "x", F.lit("</channel></rss>")))
    xml = F.when(F.col("feed") % 11 == 7, F.substring(whole, F.lit(1), F.length(whole) - 9)).otherwise(whole)
    return files.select(F.concat(F.lit("feed"), F.col("feed").cast("string")).alias("source"), xml.alias("xml"))
