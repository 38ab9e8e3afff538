"""DuckDB SQL for the registered queries, built from the same rule tables but from no Spark code."""

from __future__ import annotations

from gistmill import rules
from gistmill.functions.curation import HINTS, PLACEHOLDERS
from gistmill.functions.text import BLOCK_TAG, ENTITIES, SITE_BODIES, SITE_FIELDS, UNREAD
from gistmill.plans.adapter import ANSWERS_SQL, ARTICLES_SQL, ITEMS_SQL, NOW, PLATFORMS, quoted

ORACLE_SQL: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _hits(text: str, kws) -> str:
    return f"len(list_filter({_list(kws)}, lambda k: contains({text}, k)))"


def _sum(text: str, rows) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {quoted(k)}) THEN {w} ELSE 0 END" for k, w in rows) + ")"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def _re2(pattern: str) -> str:
    return pattern.replace(r"\x{4e00}-\x{9fff}", "一-鿿")


_relevance = " + ".join(f"CASE WHEN contains(t, {quoted(k.lower())}) THEN {w * 15} WHEN contains(x, {quoted(k.lower())}) THEN {w * 8} ELSE 0 END" for w, kws in rules.RELEVANCE.items() for k in kws)
_density = " + ".join(f"least({_count('x', p)}, 3) * {int(w * 2)}" for p, w in rules.DENSITY)
_density = f"({_density} + least({_count('x', rules.COMPANY)}, 5) * 2 + least({_count('x', rules.STRUCTURE)}, 5)) * CASE WHEN length(x) < 200 THEN 3 WHEN length(x) < 500 THEN 6 WHEN length(x) < 1000 THEN 8 ELSE 10 END"
_authority = "CASE platform " + " ".join(f"WHEN {quoted(k)} THEN {round(v * 10)}" for k, v in rules.AUTHORITY.items()) + f" ELSE {round(rules.AUTHORITY_DEFAULT * 10)} END"
_exclusive = f"{_sum('t', rules.EXCLUSIVE)} * 10 + {_authority} + {_count('t', rules.INTERVIEW)} * 15"
_age = f"date_diff('day', CASE WHEN regexp_full_match(published, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN CAST(published AS DATE) END, DATE '{NOW}')"
_timely = f"CASE WHEN {_age} IS NULL THEN 10 WHEN {_age} <= 1 THEN 50 WHEN {_age} <= 3 THEN 35 WHEN {_age} <= 7 THEN 20 WHEN {_age} <= 14 THEN 10 ELSE 0 END + {_sum('t', [(k.lower(), w) for w, kws in rules.EVENTS.items() for k in kws])} * 5 + {_count('t', rules.HEAT)} * 10"
_weight = "CASE category " + " ".join(f"WHEN {quoted(k)} THEN {round(v * 100)}" for k, v in rules.CATEGORY_WEIGHTS.items()) + f" ELSE {round(rules.CATEGORY_DEFAULT * 100)} END"
_STARS = ["★★★★★", "★★★★☆", "★★★☆☆", "★★☆☆☆", "★☆☆☆☆"]
_stars = f"CASE WHEN raw_score >= 8 THEN '{_STARS[0]}' WHEN raw_score >= 6 THEN '{_STARS[1]}' WHEN raw_score >= 4 THEN '{_STARS[2]}' WHEN raw_score >= 2 THEN '{_STARS[3]}' ELSE '{_STARS[4]}' END"

_PARTS = f"""parts AS (SELECT *, least({_relevance}, 200) AS r, least({_density}, 200) AS d, least({_exclusive}, 100) AS e, least({_timely}, 100) AS m
  FROM (SELECT *, lower(title) AS t, lower(title || ' ' || summary) AS x FROM articles))"""
_SCORED = f"WITH {ARTICLES_SQL}, {_PARTS}, scored AS (SELECT *, CAST((r * 8 + d * 5 + e * 8 + m * 6 + 20) // 40 AS DOUBLE) / 10 AS raw_score FROM parts)"
_WEIGHED = f"{_SCORED}, weighed AS (SELECT * REPLACE (CAST(round(raw_score * 10) AS BIGINT) * {_weight} / 1000.0 AS raw_score) FROM scored), kept AS (SELECT * FROM weighed WHERE raw_score >= 1.0)"
_top = lambda n, cols="*": f"SELECT {cols} FROM kept ORDER BY raw_score DESC, seq LIMIT {n}"

ORACLE_SQL["four_dim_score"] = f"{_SCORED} SELECT seq, raw_score FROM scored"
ORACLE_SQL["score_parts"] = f"WITH {ARTICLES_SQL}, {_PARTS} SELECT seq, r / 20.0 AS relevance_score, d / 20.0 AS density_score, e / 10.0 AS exclusivity_score, m / 10.0 AS timeliness_score FROM parts"
ORACLE_SQL["category_weight"] = f"{_WEIGHED} SELECT seq, CAST(raw_score AS DOUBLE) AS raw_score FROM weighed"
ORACLE_SQL["min_score_filter"] = f"{_WEIGHED} SELECT seq, raw_score FROM kept"
ORACLE_SQL["top_articles"] = f"{_WEIGHED} {_top(50, 'seq, raw_score')}"
ORACLE_SQL["rank_articles"] = f"{_WEIGHED} SELECT CAST(row_number() OVER (ORDER BY raw_score DESC, seq) AS INTEGER) AS rank, seq FROM ({_top(15)})"
ORACLE_SQL["select_deep"] = f"{_WEIGHED} SELECT seq, raw_score FROM kept WHERE raw_score >= 4.5 ORDER BY raw_score DESC, seq LIMIT 5"
ORACLE_SQL["source_counts"] = f"{_WEIGHED} SELECT platform, count(*) AS n FROM kept GROUP BY platform"
ORACLE_SQL["score_distribution"] = f"{_WEIGHED} SELECT s.stars, count(k.seq) AS n FROM (SELECT unnest({_list(_STARS)}) AS stars) s LEFT JOIN (SELECT seq, {_stars} AS stars FROM kept) k USING (stars) GROUP BY s.stars"
ORACLE_SQL["distinct_source_count"] = f"{_WEIGHED} SELECT count(DISTINCT platform) AS n_sources FROM kept"
ORACLE_SQL["to_stars"] = f"{_SCORED} SELECT seq, {_stars} AS stars, CAST(greatest(1, least(5, floor(raw_score / 2))) AS INTEGER) AS half, CAST(greatest(1, least(5, round_even(raw_score, 0))) AS INTEGER) AS rounded FROM scored"
ORACLE_SQL["normalize_scores"] = f"{_SCORED}, b AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM scored) SELECT seq, round(CASE WHEN hi = lo THEN 3.0 ELSE 1 + 4 * (raw_score - lo) / (hi - lo) END, 6) AS raw_score FROM scored, b"

_clean = r"trim(lower(regexp_replace(title, '[^\p{L}\p{N}\p{M}_\s]', '', 'g')))"
_DEDUPED = f"{_WEIGHED}, best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {_clean} ORDER BY raw_score DESC, seq) = 1)"
ORACLE_SQL["dedup_titles_exact"] = f"{_DEDUPED} SELECT seq, title FROM best"
ORACLE_SQL["daily_digest_exact"] = f"{_DEDUPED} SELECT CAST(row_number() OVER (ORDER BY raw_score DESC, seq) AS INTEGER) AS rank, seq, platform, title, raw_score, {_stars} AS stars FROM (SELECT * FROM best ORDER BY raw_score DESC, seq LIMIT 50)"

_SIG = ", ".join(f"regexp_matches(content, {quoted(p)}) AS {n}" for n, p in rules.SIGNALS)
_signals = lambda source: rf"(SELECT *, length(content) > 3000 AS is_long_form, length(content) > 5000 AS is_deep, len(regexp_extract_all(content, '(?:^|\n)#{{1,3}}\s+(.+)')) AS section_count, len(regexp_extract_all(content, '\n\n+')) + 1 AS paragraph_count, {_SIG} FROM {source})"
_SIGNALS = f"signals AS {_signals('articles')}"
_depth = " + ".join(
    [
        "CASE WHEN is_deep THEN 15 WHEN is_long_form THEN 8 ELSE 0 END",
        "CASE WHEN section_count >= 3 THEN 5 ELSE 0 END",
        "CASE WHEN section_count >= 5 THEN 5 ELSE 0 END",
        "CASE WHEN paragraph_count >= 15 THEN 5 ELSE 0 END",
        *[f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in rules.DEPTH_TENTHS.items()],
        f"least({_hits('lower(content)', [k.lower() for k in rules.DEPTH_WORDS])}, 10)",
    ]
)
_level = "CASE WHEN score >= 4 THEN '深度' WHEN score >= 2 THEN '中度' ELSE '浅层' END"
_DEEP = f"WITH {ARTICLES_SQL}, {_SIGNALS}, deep AS (SELECT *, least({_depth}, 100) / 10.0 AS score FROM signals)"
ORACLE_SQL["article_signals"] = f"WITH {ARTICLES_SQL}, {_SIGNALS} SELECT seq, is_long_form, is_deep, CAST(section_count AS INTEGER) AS section_count, CAST(paragraph_count AS INTEGER) AS paragraph_count, {', '.join(n for n, _ in rules.SIGNALS)} FROM signals"
ORACLE_SQL["depth_score"] = f"{_DEEP} SELECT seq, CAST(score AS DOUBLE) AS score, {_level} AS level FROM deep"
ORACLE_SQL["level_counts"] = f"{_DEEP} SELECT count(*) AS total, count_if(score >= 4) AS deep_count, count_if(score >= 2 AND score < 4) AS medium_count, count_if(score < 2) AS shallow_count FROM deep"

_filled = lambda a, b: f"coalesce(nullif({a}, ''), nullif({b}, ''), '')"
ORACLE_SQL["project_articles"] = f"{_DEEP} SELECT seq, title, platform AS source, url, md5(substr({_filled('summary', 'content')}, 1, 300)) AS summary_md5, md5(substr({_filled('content', 'summary')}, 1, 2000)) AS content_md5, CAST(score AS DOUBLE) AS score, {_level} AS level FROM deep"

_tenths = " UNION ALL ".join(f"SELECT {i} AS ord, {quoted(n)} AS name, {round(w * 10)} AS w, {_list([k.lower() for k in kws])} AS kws" for i, (n, w, kws) in enumerate(rules.INTEREST))
_INTEREST = f"""interest AS (
  SELECT a.seq, a.platform, coalesce(b.name, '') AS category, greatest(0, CASE WHEN b.name IS NULL THEN 0 ELSE b.tenths - {_hits('a.x', [k.lower() for k in rules.PENALTY])} * 20 END) / 10.0 AS score
  FROM (SELECT *, lower(title || ' ' || summary) AS x FROM articles) a
  LEFT JOIN (SELECT seq, arg_max(name, tenths * 100 - ord) AS name, max(tenths) AS tenths FROM (
      SELECT seq, ord, name, w + 5 * len(list_filter(kws, lambda k: contains(x, k))) AS tenths, len(list_filter(kws, lambda k: contains(x, k))) AS n
      FROM (SELECT seq, lower(title || ' ' || summary) AS x FROM articles) CROSS JOIN ({_tenths})) WHERE n > 0 GROUP BY seq) b
    ON a.seq = b.seq AND {_hits('a.x', [k.lower() for k in rules.DOMAIN_WORDS])} > 0)"""
ORACLE_SQL["interest_classify"] = f"WITH {ARTICLES_SQL}, {_INTEREST} SELECT seq, category, CAST(score AS DOUBLE) AS score FROM interest"
ORACLE_SQL["interest_gate"] = f"WITH {ARTICLES_SQL}, {_INTEREST} SELECT seq, platform FROM interest WHERE score >= 2"
_two = "title || ' ' || summary"
ORACLE_SQL["signal_gate"] = f"WITH {ARTICLES_SQL} SELECT seq FROM articles WHERE NOT regexp_matches({_two}, {quoted('|'.join(rules.LOW_QUALITY))}) AND length(title) >= 10 AND {_hits(_two, rules.DEEP_SIGNALS)} >= 1"
ORACLE_SQL["quality_sort"] = f"WITH {ARTICLES_SQL} SELECT seq, CAST({_hits(_two, rules.DEEP_SIGNALS)} AS INTEGER) AS n_signals FROM articles"
ORACLE_SQL["keyword_hits"] = f"WITH {ARTICLES_SQL} SELECT seq, CAST({_hits('title', rules.DEEP_SIGNALS)} AS INTEGER) AS signals, CAST({_hits('lower(summary)', [k.lower() for k in rules.PENALTY])} AS INTEGER) AS penalties FROM articles"
ORACLE_SQL["select_sources"] = f"WITH {ARTICLES_SQL} SELECT seq, platform FROM articles WHERE platform IN ('36氪', '虎嗅', 'unknown')"
ORACLE_SQL["ai_title_filter"] = f"WITH {ARTICLES_SQL} SELECT seq FROM articles WHERE {_hits('lower(title)', rules.AI_TOKENS)} > 0"
ORACLE_SQL["skip_domains"] = f"WITH {ARTICLES_SQL} SELECT seq FROM articles WHERE NOT contains(url, 'example.com/fr') AND NOT contains(url, 'example.com/de')"
ORACLE_SQL["needs_full_text"] = f"WITH {ARTICLES_SQL} SELECT seq, length(content) < 500 AND url <> '' AS needs FROM articles"
ORACLE_SQL["cap_per_source"] = f"WITH {ARTICLES_SQL} SELECT seq, platform FROM articles WHERE seq // {len(PLATFORMS)} < CASE platform WHEN '量子位' THEN 30 WHEN 'huggingface' THEN 30 WHEN 'github' THEN 40 ELSE 50 END"
ORACLE_SQL["union_sources"] = f"WITH {ARTICLES_SQL} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'rss' ELSE 'list' END AS source_type, title, CASE WHEN seq % 2 = 1 THEN author END AS author, CASE WHEN seq % 2 = 0 THEN md5(content) END AS content_md5 FROM articles"
ORACLE_SQL["dedup_urls"] = f"WITH {ARTICLES_SQL} SELECT seq, url FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1"
ORACLE_SQL["attach_source_info"] = f"WITH {ARTICLES_SQL} SELECT seq, CASE WHEN i < 8 THEN '源-' || platform ELSE platform END AS source_name, CASE WHEN i < 8 THEN CASE WHEN i % 2 = 1 THEN 'direct' ELSE 'rsshub' END END AS source_kind, CASE WHEN i < 8 THEN 'AI技术' END AS source_category FROM (SELECT seq, platform, list_position({_list(PLATFORMS)}, platform) - 1 AS i FROM articles)"
_words = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+'))"
_overlap = lambda a, b: f"(SELECT CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END FROM (SELECT {_words.format(a)} AS a, {_words.format(b)} AS b))"
ORACLE_SQL["text_overlap"] = f"WITH {ARTICLES_SQL} SELECT seq, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS overlap FROM (SELECT seq, {_words.format('summary')} AS a, {_words.format('content')} AS b FROM articles)"


def _argmax(text: str, rows, default: str) -> str:
    """First category with most hits."""
    names = _list([n for n, _ in rows])
    hits = "[" + ", ".join(_hits(text, kws) for _, kws in rows) + "]"
    return f"CASE WHEN list_max({hits}) > 0 THEN ({names})[list_position({hits}, list_max({hits}))] ELSE {quoted(default)} END"


_topic = _argmax("lower(title || ' ' || substr(content, 1, 2000))", [(n, [k.lower() for k in kws]) for n, kws in rules.TOPICS], rules.TOPIC_DEFAULT)
_TOPICS = f"WITH {ARTICLES_SQL}, topics AS (SELECT *, {_topic} AS topic FROM articles)"
ORACLE_SQL["topic_classify"] = f"{_TOPICS} SELECT seq, topic FROM topics"
ORACLE_SQL["topic_histogram"] = f"{_TOPICS} SELECT topic AS category, count(*) AS n FROM topics GROUP BY topic"
ORACLE_SQL["industry_table"] = f"{_DEEP}, best AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank, {_topic} AS topic FROM (SELECT * FROM deep ORDER BY score DESC, seq LIMIT 50)) SELECT topic AS category, substr(arg_min(title, rank), 1, 40) AS title, arg_min(platform, rank) AS platform, CAST(least(count(*), 3) AS BIGINT) AS heat, CAST(min(rank) AS INTEGER) AS first_rank FROM best GROUP BY topic ORDER BY min(rank) LIMIT 8"
ORACLE_SQL["category_groups"] = f"{_WEIGHED}, best AS (SELECT *, row_number() OVER (ORDER BY raw_score DESC, seq) AS rank FROM ({_top(50)})) SELECT coalesce(nullif(category, ''), '其他') AS category, count(*) AS n, CAST(min(rank) AS INTEGER) AS first_rank, string_agg(title, '|' ORDER BY rank) AS titles FROM best GROUP BY 1"
ORACLE_SQL["source_footprint"] = f"{_WEIGHED} SELECT CAST(s.ord AS INTEGER) AS ord, s.platform, count(k.seq) AS n, CASE WHEN count(k.seq) > 0 THEN '✅' ELSE '—' END AS status FROM (SELECT unnest(range(6)) AS ord, unnest(['36氪', '虎嗅', '爱范儿', '量子位', '少数派', '知乎']) AS platform) s LEFT JOIN kept k USING (platform) GROUP BY 1, 2"
ORACLE_SQL["check_links"] = f"{_WEIGHED}, best AS (SELECT *, row_number() OVER (ORDER BY raw_score DESC, seq) AS rank FROM ({_top(15)})) SELECT CAST(rank AS INTEGER) AS rank, seq, CASE WHEN best.url = '' OR {_hits('best.url', rules.SKIP_HOSTS)} > 0 THEN 'skipped' WHEN p.page_id IS NULL OR p.page_id % 5 = 0 THEN 'dead' ELSE 'ok' END AS link FROM best LEFT JOIN (SELECT * FROM pages WHERE page_id % 11 <> 0) p ON best.url = p.url"

_kinds = "CASE template_id " + " ".join(f"WHEN {quoted(i)} THEN {quoted(k)}" for i, k, _ in rules.TEMPLATES) + " END"


def _subs() -> str:
    cases = []
    for domain, labels in rules.SUBDOMAINS.items():
        found = "list_filter([" + ", ".join(f"CASE WHEN {_hits('x', kws)} > 0 THEN {quoted(n)} END" for n, kws in labels) + "], lambda s: s IS NOT NULL)"
        cases.append(f"WHEN {quoted(domain)} THEN list_slice({found}, 1, 3)")
    return "CASE domain " + " ".join(cases) + " ELSE [] END"


_CURATED = f"""WITH {ARTICLES_SQL}, c1 AS (SELECT *, title || ' ' || summary || ' ' || substr(content, 1, 2000) AS x FROM articles),
c2 AS (SELECT *, {_argmax('x', [(i, k) for i, _, k in rules.TEMPLATES], rules.TEMPLATE_DEFAULT)} AS template_id, {_argmax('x', rules.DOMAINS, rules.DOMAIN_DEFAULT)} AS domain FROM c1),
c3 AS (SELECT *, {_kinds} AS knowledge_type, substr(domain, 4) AS domain_name, {_subs()} AS subs FROM c2),
curated AS (SELECT *, strftime(DATE '{NOW}', '%Y') || '-' || substr(domain_name, 1, 6) || '-' || substr(md5(title), 1, 6) AS knowledge_id,
  list_slice(list_sort(list_distinct(list_filter({_list(rules.ENTITIES)}, lambda e: contains(lower(x), lower(e))) || [platform, knowledge_type])), 1, 10) AS tags,
  knowledge_type || '/' || domain || '/' || substr(regexp_replace(title, '[\\\\/:*?"<>|]', '-', 'g'), 1, 60) || '.md' AS rel_path FROM c3)"""
ORACLE_SQL["curate_articles"] = f"{_CURATED} SELECT seq, template_id, knowledge_type, domain, domain_name, knowledge_id, array_to_string(subs, '|') AS subdomains, array_to_string(tags, '|') AS tags FROM curated"
ORACLE_SQL["version_paths"] = f"""{_CURATED}, held AS (SELECT DISTINCT rel_path FROM curated WHERE seq % 5 = 0),
placed AS (SELECT seq, rel_path, row_number() OVER (PARTITION BY rel_path ORDER BY seq) + CASE WHEN rel_path IN (SELECT rel_path FROM held) THEN 1 ELSE 0 END AS v FROM curated WHERE seq % 5 <> 0)
SELECT seq, rel_path, CASE WHEN v = 1 OR v > 99 THEN rel_path ELSE regexp_replace(rel_path, '\\.md$', '') || '_v' || v || '.md' END AS final_path FROM placed"""
ORACLE_SQL["append_index_entries"] = f"""{_CURATED}, keyed AS (SELECT *, knowledge_type || '/' || domain AS index_key FROM curated),
fresh AS (SELECT * FROM keyed k WHERE seq % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM keyed i WHERE i.seq % 3 = 0 AND i.index_key = k.index_key AND (i.rel_path = k.rel_path OR i.title = k.title))),
one AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY index_key, rel_path ORDER BY seq) = 1),
two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY index_key, title ORDER BY seq) = 1)
SELECT seq, index_key, '- [{NOW}] [[' || regexp_replace(rel_path, '\\.md', '', 'g') || '|' || title || ']]' AS entry FROM two"""
_hint = "CASE template_id " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in HINTS.items()) + " ELSE '' END"
ORACLE_SQL["build_prompt"] = f"""{_CURATED} SELECT seq, md5(CASE WHEN length(content) >= 100 THEN '# 深度解读任务' || chr(10) || chr(10) || {_hint} || chr(10) || chr(10) || substr(content, 1, 8000)
  || CASE WHEN length(content) > 8000 THEN chr(10) || chr(10) || '[原文共 ' || length(content) || ' 字，此处仅截取前 8000 字]' ELSE '' END END) AS prompt_md5 FROM curated"""
ORACLE_SQL["note_counts"] = f"SELECT '02-专业知识库/' || ({_list([d for d, _ in rules.DOMAINS])})[(item_id % {len(rules.DOMAINS)}) + 1] AS folder, count(*) AS n FROM benchmark GROUP BY 1"
ORACLE_SQL["new_items"] = f"WITH {ITEMS_SQL} SELECT min(seq) AS seq, media_id FROM items WHERE folder_id IS NULL AND media_id NOT IN (SELECT media_id FROM items WHERE seq < 300) GROUP BY media_id"
ORACLE_SQL["parse_published"] = f"WITH {ARTICLES_SQL} SELECT seq, CASE WHEN published LIKE 'Tue, %' THEN strftime(strptime(substr(published, 6, 11), '%d %b %Y'), '%Y-%m-%d') WHEN regexp_full_match(published, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN published END AS day FROM articles"
_line = r"regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-*•]\s*', ''), '^[0-9]+[.、]\s*', '')"
_items = lambda text: f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_line}), lambda x: length(x) >= 6 AND NOT list_contains({_list(PLACEHOLDERS)}, x))"
ORACLE_SQL["parse_sections"] = f"""WITH {ANSWERS_SQL}, got AS (SELECT conv_id, turn, {_items('one')} AS t, {_items('topic')} AS c, {_items("'- ' || frame")} AS f, {_items("'1. 六个字以上的句子' || chr(10) || said")} AS i, {_items("'- ' || act")} AS a FROM answers)
SELECT conv_id, turn, coalesce(t[1], '') AS thesis, coalesce(c[1], '') AS category, array_to_string(f, '|') AS frameworks, md5(array_to_string(i, '|')) AS insights_md5, 0 AS n_data, array_to_string(a, '|') AS takeaways,
  least(100, (len(i) + len(a) + CASE WHEN len(t) > 0 THEN 1 ELSE 0 END) * 12) / 10.0 AS quality_score FROM got"""
_noise = lambda x: f"regexp_matches({x}, {quoted('(?i)' + '|'.join(f'(?:{n})' for n in rules.NOISE_LINES))})"
_cjk = _count("content", "[一-鿿]")
ORACLE_SQL["content_quality"] = f"""WITH {ARTICLES_SQL}, counted AS (SELECT seq, content, {_cjk} AS cjk, string_split(content, chr(10)) AS lines FROM articles),
noisy AS (SELECT *, len(list_filter(lines, lambda x: {_noise('trim(x)')})) AS n FROM counted),
rated AS (SELECT seq, content, CAST(cjk AS INTEGER) AS cjk, CAST(CASE WHEN content = '' THEN 0 ELSE len(lines) END AS INTEGER) AS total_lines, CAST(CASE WHEN content = '' THEN 0 ELSE n END AS INTEGER) AS noise_lines, CASE WHEN content = '' THEN 1.0 ELSE round(n / len(lines), 2) END AS noise_ratio FROM noisy)
SELECT seq, noise_ratio, cjk, total_lines, noise_lines, CASE WHEN length(content) < 200 THEN 'fallback' WHEN noise_ratio > 0.3 OR cjk < 50 THEN 'low_quality' WHEN length(content) >= 500 THEN 'success' ELSE 'partial' END AS status FROM rated"""
_strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SANITIZED = f"""cleaned AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: CASE WHEN {_strip('x')} = '' THEN '' WHEN NOT regexp_matches(x, '[一-鿿]') AND length({_strip('x')}) < 15 THEN NULL WHEN {_noise(_strip('x'))} THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS k FROM articles),
sanitized AS (SELECT * REPLACE (array_to_string(list_filter(k, lambda x, i: x <> '' OR (i > 1 AND k[i - 1] <> '')), chr(10)) AS content) FROM cleaned)"""
ORACLE_SQL["sanitize_content"] = f"WITH {ARTICLES_SQL}, {_SANITIZED} SELECT seq, md5(content) AS text_md5 FROM sanitized"
_depth_of = lambda source: f"(SELECT *, least({_depth}, 100) / 10.0 AS score FROM {_signals(source)})"
ORACLE_SQL["select_digest_sections"] = f"""WITH {ARTICLES_SQL}, {_SANITIZED}, good AS (SELECT seq FROM {_depth_of('sanitized')} WHERE length(content) >= 200 AND score >= 1.0),
rated AS (SELECT seq, score, seq IN (SELECT seq FROM good) AND content <> '' AS ok FROM {_depth_of('articles')}),
deep AS (SELECT * FROM (SELECT * FROM rated WHERE score >= 4 ORDER BY score DESC, seq LIMIT 5) WHERE ok),
more AS (SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS r FROM rated WHERE score >= 2 AND score < 4 AND ok)
SELECT 'deep' AS section, seq, CAST(score AS DOUBLE) AS score FROM deep
UNION ALL SELECT 'deep', seq, CAST(score AS DOUBLE) FROM more WHERE r <= 3 - (SELECT count(*) FROM deep)
UNION ALL (SELECT 'brief', seq, CAST(score AS DOUBLE) FROM rated WHERE score >= 2 AND score < 4 ORDER BY score DESC, seq LIMIT 15)"""
_gram = lambda n: f"list_transform(range(1, greatest(length(h) - {n - 2}, 1)), lambda i: substr(h, i, {n}))"
ORACLE_SQL["tokenize_ngrams"] = f"WITH {ARTICLES_SQL}, h AS (SELECT seq, title AS t, regexp_replace(title, '[^一-鿿]', '', 'g') AS h FROM articles) SELECT seq, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda w: length(w) >= 2) || list_filter({_gram(2)} || {_gram(3)} || {_gram(4)}, lambda g: NOT regexp_full_match(g, '[{rules.FUNCTION_CHARS}]+')))), ',') AS tokens FROM h"


def _replaced(text: str, pairs) -> str:
    for entity, char in pairs:
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    return text


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
_SCRIPTS = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>"
_BLOCKS = "</?(?:div|p|br|h[1-6]|li|tr|section|article|blockquote|pre{more})[^>]*>"


def _gone(text: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {by}, 'g')"


def _tidy(page: str) -> str:
    """A page's text without noise."""
    text = _gone(_gone(_gone(_gone(page, _SCRIPTS), "(?s)<!--.*?-->"), "(?s)<svg[^>]*>.*?</svg>"), r'\s*(?:style|on\w+)="[^"]*"')
    text = _replaced(_gone(_gone(text, _BLOCKS.format(more="|main|aside"), "chr(10)"), "<[^>]+>"), _ENTITIES)
    return _gone(_gone(_gone(text, r"\n{3,}", "chr(10) || chr(10)"), " {2,}", "' '"), r"^\s+|\s+$")


ORACLE_SQL["strip_html_noise"] = f"SELECT page_id, md5({_tidy('html')}) AS text_md5 FROM pages"


def _site(page: str, platform: str) -> str:
    """Container of a platform's body."""
    cases = []
    for name, patterns in SITE_BODIES.items():
        found = [f"nullif(regexp_extract({page}, {quoted(x)}, 1), '')" for x in patterns]
        if name in SITE_FIELDS:
            found = [f"nullif(replace(replace(regexp_extract({page}, {quoted(SITE_FIELDS[name])}, 1), '\\n', chr(10)), '\\\"', '\"'), '')", *found]
        cases.append(f"WHEN {quoted(name)} THEN coalesce({', '.join(found)})")
    return f"CASE {platform} {' '.join(cases)} END"


def _heuristic(page: str, key: str, source: str) -> str:
    """Subquery (key, body): the best paragraphs of each page."""
    text = page
    for tag in ("header", "nav", "footer", "script", "style", "noscript", "svg", "iframe"):
        text = _gone(text, f"(?is)<{tag}[^>]*>.*?</{tag}>")
    text = _replaced(_gone(_gone(text, _BLOCKS.format(more=""), "chr(10)"), "<[^>]+>"), _ENTITIES)
    mark = f"(len(regexp_extract_all(x, '\\p{{L}}')) - 2 * len(regexp_extract_all(x, '[{{}}();]')))"
    rows = f"list_transform(string_split_regex({text}, '\\n\\s*\\n'), lambda x, i: {{'score': -{mark}, 'i': i, 'text': {_gone('x', r'^\s+|\s+$')}}})"
    best = f"list_slice(list_sort(list_filter({rows}, lambda r: r.score < -30)), 1, 20)"
    body = f"array_to_string(list_transform({best}, lambda r: r.text), chr(10) || chr(10))"
    return f"(SELECT {key}, CASE WHEN length(body) > 200 THEN body END AS body FROM (SELECT {key}, {body} AS body FROM {source}))"


ORACLE_SQL["extract_heuristic_body"] = f"SELECT page_id, md5(body) AS text_md5 FROM {_heuristic('html', 'page_id', 'pages')}"
_platform = "['36氪', '虎嗅', '量子位', '爱范儿', '少数派', '知乎'][page_id % 6 + 1]"
_landed = "CASE WHEN page_id % 12 = 5 THEN '{\"content\": \"' || replace(replace(html, '\"', '\\\"'), chr(10), '\\n') || '\", \"excerpt\": \"\"}' ELSE html END"
ORACLE_SQL["extract_site_body"] = f"SELECT page_id, md5({_tidy('body')}) AS text_md5 FROM (SELECT page_id, {_site('html', 'platform')} AS body FROM (SELECT page_id, {_platform} AS platform, {_landed} AS html FROM pages))"
_UNREAD = "html"
for _tag in UNREAD:
    _UNREAD = f"regexp_replace({_UNREAD}, '(?is)<{_tag}(?:\\s[^>]*)?>.*?</{_tag}\\s*>', '', 'g')"
_MARKED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_UNREAD}, '(?s)<!--.*?-->', '', 'g'), '[\\x01\\x02 \\t\\r\\n]+', ' ', 'g'), '(?i)<a(?:\\s[^>]*)?>', chr(1), 'g'), '(?i)</a\\s*>', chr(2), 'g')"
_CUT = f"regexp_replace(regexp_replace({_MARKED}, '{BLOCK_TAG}', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _entity, _char in ENTITIES:
    _CUT = f"replace({_CUT}, {quoted(_entity)}, {quoted(_char)})"
ORACLE_SQL["extract_dense_body"] = f"""WITH cut AS (SELECT page_id, string_split({_CUT}, chr(10)) AS parts FROM pages),
blocks AS (SELECT page_id, unnest(parts) AS b, generate_subscripts(parts, 1) AS i FROM cut),
sized AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(b, '[\\x01\\x02]', '', 'g'), ' {{2,}}', ' ', 'g'), ' ') AS t, length(regexp_replace(b, '[\\x01\\x02 ]', '', 'g')) AS n,
  length(replace(regexp_replace(regexp_replace(b, '\\x01[^\\x02]*\\x02?', '', 'g'), '[\\x01\\x02]', '', 'g'), ' ', '')) AS f FROM blocks),
weighed AS (SELECT page_id, i, t, CASE WHEN 3 * (n - f) <= n THEN f ELSE 0 END AS w FROM sized WHERE n > 0),
smooth AS (SELECT page_id, i, t, w, lag(w, 1, 0) OVER o + 2 * w + lead(w, 1, 0) OVER o AS s FROM weighed WINDOW o AS (PARTITION BY page_id ORDER BY i)),
bodies AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS body FROM smooth WHERE w > 0 AND s >= 160 GROUP BY 1 HAVING length(body) > 200)
SELECT p.page_id, CAST(length(body) AS INTEGER) AS n_chars, md5(body) AS text_md5 FROM pages p LEFT JOIN bodies USING (page_id)"""
ORACLE_SQL["attach_full_text"] = f"""WITH {ARTICLES_SQL}, wanted AS (SELECT DISTINCT p.page_id, p.url, a.platform, p.html FROM articles a JOIN pages p ON a.url = p.url WHERE length(a.content) < 500 AND a.url <> ''),
sites AS (SELECT page_id, url, platform, {_tidy('body')} AS body FROM (SELECT page_id, url, platform, {_site('html', 'platform')} AS body FROM wanted)),
guesses AS {_heuristic('html', 'page_id', '(SELECT DISTINCT page_id, html FROM wanted)')},
bodies AS (SELECT s.url, s.platform, max(coalesce(CASE WHEN length(s.body) > 200 THEN s.body END, g.body)) AS body FROM sites s JOIN guesses g USING (page_id) GROUP BY 1, 2),
filled AS (SELECT a.seq, CASE WHEN length(a.content) < 500 AND a.url <> '' AND length(b.body) > 200 THEN b.body ELSE a.content END AS content FROM articles a LEFT JOIN bodies b ON a.url = b.url AND a.platform = b.platform)
SELECT seq, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5 FROM filled"""
ORACLE_SQL["two_stage_rescore"] = f"""WITH {ARTICLES_SQL}, pre AS (SELECT seq, url, summary, platform, score AS prescore FROM {_depth_of('(SELECT seq, url, summary, platform, summary AS content FROM articles)')}),
chosen AS (SELECT * FROM (SELECT * FROM pre ORDER BY prescore DESC, seq LIMIT 15) WHERE platform <> 'github' ORDER BY prescore DESC, seq LIMIT 10),
texts AS (SELECT c.seq, max(h.body) AS body FROM chosen c JOIN pages p ON c.url = p.url JOIN {_heuristic('html', 'page_id', 'pages')} h ON h.page_id = p.page_id GROUP BY c.seq),
both_ AS (SELECT pre.seq, prescore, coalesce(nullif(body, ''), summary) AS content FROM pre LEFT JOIN texts USING (seq))
SELECT seq, CAST(prescore AS DOUBLE) AS prescore, CAST(score AS DOUBLE) AS score FROM {_depth_of('both_')}"""
_simple = _gone(_gone(_gone("html", _SCRIPTS), "(?s)<!--.*?-->"), "<[^>]+>", "' '")
_simple = f"list_filter(list_transform(string_split({_gone(_replaced(_simple, rules.SIMPLE_ENTITIES), '[ \\t]+', "' '")}, chr(10)), lambda x: {_gone('x', '^\\s+|\\s+$')}), lambda x: x <> '')"
ORACLE_SQL["extract_text_simple"] = f"SELECT page_id, md5(CASE WHEN length(t) >= 100 THEN t END) AS text_md5 FROM (SELECT page_id, substr(array_to_string({_simple}, chr(10)), 1, 8000) AS t FROM pages)"
_bare = _gone("html", "<[^>]+>")
ORACLE_SQL["strip_html"] = f"SELECT page_id, md5(substr({_gone(_gone(_replaced(_bare, _ENTITIES), '\\s+', "' '"), '^\\s+|\\s+$')}, 1, 500)) AS feed_md5, md5({_gone(_gone(_bare, '\\s+', "' '"), '^\\s+|\\s+$')}) AS basic_md5 FROM pages"
ORACLE_SQL["parse_item_xml_text"] = f"SELECT page_id, md5({_gone(_gone(_replaced(_gone('html', '<[^>]+>', 'chr(10)'), _ENTITIES), '\\n\\s*\\n+', 'chr(10)'), '^\\s+|\\s+$')}) AS text_md5 FROM pages"
ORACLE_SQL["decode_body"] = "SELECT page_id, md5(html) AS text_md5 FROM pages"
_json = lambda c: f"'[' || array_to_string(list_transform({c}, lambda v: chr(34) || v || chr(34)), ', ') || ']'"
_yaml = "|| chr(10) ||".join(["'---'", "'knowledge_id: \"' || knowledge_id || '\"'", "'type: \"' || knowledge_type || '\"'", "'domain: \"' || domain_name || '\"'", f"'subdomain: ' || {_json('subs')}", f"'tags: ' || {_json('tags')}", f"'created: \"{NOW}\"'", f"'updated: \"{NOW}\"'", "'source: \"' || url || '\"'", "'source_type: \"行业媒体-' || platform || '\"'", "'depth_score: ' || printf('%.1f', CAST(score AS DOUBLE))", "'---'", "''"])
_CURATED_DEEP = _CURATED.replace(f"WITH {ARTICLES_SQL}", f"{_DEEP}".removeprefix(" "), 1).replace("substr(content, 1, 2000) AS x FROM articles", "substr(content, 1, 2000) AS x FROM deep", 1)
ORACLE_SQL["build_frontmatter"] = f"{_CURATED_DEEP} SELECT seq, {_yaml} AS yaml, rel_path FROM curated"
ORACLE_SQL["focus_categories"] = f"{_WEIGHED} SELECT string_agg(DISTINCT category, '|' ORDER BY category) AS categories, CAST(count(DISTINCT category) AS INTEGER) AS n FROM ({_top(3)})"
_folder = "CASE WHEN category IN ('AI技术', '投资分析', '经济趋势', '产业研究') THEN '02-专业知识库/' || category ELSE '02-专业知识库' END"
_card = f"""'---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'source_url: "' || url || '"' || chr(10) || 'date: {NOW}' || chr(10) || 'category: ' || category || chr(10) || 'tags:' || chr(10) || array_to_string(list_transform(tags, lambda t: '  - ' || t), chr(10)) || chr(10) || '---' || chr(10) || chr(10) || content || chr(10)"""
ORACLE_SQL["knowledge_card"] = f"{_CURATED} SELECT seq, {_folder} || '/' || substr(translate(title, '/\\', '--'), 1, 80) || '.md' AS rel_path, md5({_card}) AS card_md5 FROM curated"

_RANKED = f"{_WEIGHED}, best AS (SELECT *, CAST(row_number() OVER (ORDER BY raw_score DESC, seq) AS INTEGER) AS rank FROM ({_top(15)}))"
_PAGE_TEXT = _gone(_gone(_gone("substr(html, 1, 5120)", "<[^>]+>", "' '"), r"\s+", "' '"), r"^\s+|\s+$")
_REPAIRED = f"""{_RANKED}, texts AS (SELECT url, max(substr({_PAGE_TEXT}, 1, 300)) AS page_text FROM pages WHERE url IN (SELECT url FROM best) GROUP BY url),
repaired AS (SELECT best.* EXCLUDE (summary), coalesce(page_text, '') <> '' AND {_overlap('substr(summary, 1, 200)', "coalesce(page_text, '')")} < 0.7 AS fixed, summary, page_text FROM best LEFT JOIN texts USING (url))"""
ORACLE_SQL["repair_summaries"] = f"{_REPAIRED} SELECT rank, seq, fixed, md5(CASE WHEN fixed THEN substr(page_text, 1, 150) ELSE summary END) AS summary_md5 FROM repaired"
ORACLE_SQL["check_summary"] = f"""{_REPAIRED}, crawl AS (SELECT url, min(CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END) AS status FROM pages WHERE page_id % 11 <> 0 GROUP BY url),
states AS (SELECT r.fixed, CASE WHEN r.url = '' OR {_hits('r.url', rules.SKIP_HOSTS)} > 0 THEN 'skipped' WHEN c.status IS NULL OR c.status >= 400 THEN 'dead' ELSE 'ok' END AS link FROM repaired r LEFT JOIN crawl c USING (url))
SELECT count_if(link <> 'skipped') AS checked, count_if(link = 'dead') AS dead, count_if(fixed) AS fixed FROM states"""
_label = "CASE platform " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.SOURCE_LABELS.items()) + f" ELSE {quoted(rules.SOURCE_LABEL_DEFAULT)} END"
_nl = "chr(10) || chr(10)"
_entry = f"'### ' || rank || '. ' || title || '  ' || {_stars} || {_nl} || '**来源**: ' || platform || ' | **类型**: ' || {_label} || {_nl} || trim(substr(coalesce(summary, ''), 1, 150)) || {_nl} || '🔗 [' || platform || '原文](' || url || ')'"
ORACLE_SQL["render_digest"] = f"""{_RANKED} SELECT '# AI 日报 {NOW} (周{rules.WEEKDAYS[NOW.weekday()]})' || {_nl} || '> 📊 **采集源**: ' || count(DISTINCT platform) || ' 个 | **收录**: ' || count(*) || ' 篇' || {_nl} || '---' || {_nl}
  || string_agg({_entry}, {_nl} || '---' || {_nl} ORDER BY rank) || {_nl} || '---' || {_nl} || '> 📅 下次更新: ' || strftime(DATE '{NOW}' + 1, '%Y-%m-%d') || ' 07:00' AS body FROM best"""
ORACLE_SQL["render_digest_grouped"] = f"""{_WEIGHED}, best AS (SELECT *, CAST(row_number() OVER (ORDER BY raw_score DESC, seq) AS INTEGER) AS rank FROM ({_top(50)}))
SELECT coalesce(nullif(category, ''), '其他') AS category, count(*) AS n, string_agg('- [' || repeat('⭐', CAST(greatest(1, least(5, round_even(raw_score, 0))) AS INTEGER)) || '] [' || title || '](' || url || ') — ' || platform, chr(10) ORDER BY rank) AS body, min(rank) AS first_rank FROM best GROUP BY 1"""

_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z]+'), lambda w: length(w) >= 2) || list_filter({_gram(2)} || {_gram(3)} || {_gram(4)}, lambda g: NOT regexp_full_match(g, '[{rules.FUNCTION_CHARS}]+')))"
_terms = lambda key, source, more: f"(SELECT {key}, {_TERMS} AS terms, {more} FROM (SELECT *, title AS t, regexp_replace(title, '[^一-鿿]', '', 'g') AS h FROM {source}))"
_ALL_SUBS = _list(sorted({n for rows in rules.SUBDOMAINS.values() for n, _ in rows}))
_pick_sql = lambda values, i: f"({_list(values)})[({i}) % {len(values)} + 1]"


def _headlines() -> list[str]:
    from gistmill.plans.adapter import HEADLINES

    return HEADLINES


_NOTES = f"""notes AS (SELECT item_id, {_pick_sql(_headlines(), 'item_id * 3 + 1')} || ' ' || item_id AS title, [{_pick_sql(rules.ENTITIES, 'item_id')}, {_pick_sql(PLATFORMS, 'item_id')}, {_pick_sql(['案例', '动态', '方法'], 'item_id')}] AS tags,
  '02-专业知识库/' || {_pick_sql([d for d, _ in rules.DOMAINS], 'item_id')} || '/' || {_pick_sql(_headlines(), 'item_id * 3 + 1')} || ' ' || item_id || '.md' AS rel_path, text AS body FROM benchmark)"""
ORACLE_SQL["note_snapshots"] = f"""WITH {_NOTES} SELECT n.item_id, n.rel_path, md5(CASE WHEN n.item_id % 3 = 1 THEN b.text || chr(10) || '(v2)' ELSE b.text END) AS body_md5
FROM notes n JOIN benchmark b USING (item_id) WHERE n.item_id % 3 <> 1 OR n.item_id % 6 = 1"""
ORACLE_SQL["suggest_links"] = f"""{_CURATED}, {_PARTS.replace('FROM articles', 'FROM (SELECT * EXCLUDE (x) FROM curated)')}, scored AS (SELECT *, CAST((r * 8 + d * 5 + e * 8 + m * 6 + 20) // 40 AS DOUBLE) / 10 AS raw_score FROM parts),
picked AS (SELECT * FROM scored WHERE raw_score >= 1.0 ORDER BY raw_score DESC, seq LIMIT 40),
{_NOTES}, c AS {_terms('seq', 'picked', 'list_distinct(tags) AS tags, domain_name, subs')}, n AS {_terms('rel_path, title', 'notes', 'list_distinct(tags) AS tags')},
pairs AS (SELECT seq, rel_path, title, domain_name, list_sort(list_intersect(c.terms, n.terms)) AS st, list_sort(list_intersect(c.tags, n.tags)) AS sg, contains(rel_path, domain_name) AS same_domain, list_filter(subs, lambda s: contains(title || chr(10) || rel_path, s)) AS ss FROM c CROSS JOIN n),
rated AS (SELECT *, 3 * len(st) + 2 * len(sg) + CASE WHEN same_domain THEN 5 ELSE 0 END + CASE WHEN len(ss) > 0 THEN 4 ELSE 0 END AS score FROM pairs),
placed AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, rel_path) AS place FROM rated WHERE score > 0)
SELECT seq, rel_path, title, CAST(score AS INTEGER) AS score, CAST(len(st) AS INTEGER) AS n_terms, CAST(len(sg) AS INTEGER) AS n_tags, same_domain, len(ss) > 0 AS same_subdomain,
  concat_ws(' | ', CASE WHEN len(st) > 0 THEN '关键词匹配: ' || array_to_string(st[1:3], ', ') END, CASE WHEN same_domain THEN '同域: ' || domain_name END, CASE WHEN len(sg) > 0 THEN '共享标签: ' || array_to_string(sg[1:3], ', ') END, CASE WHEN len(ss) > 0 THEN '子域: ' || ss[1] END) AS reason FROM placed WHERE place <= 8"""

_place = "CAST(seq % 10 AS INTEGER) AS pos"
_clean_title, _clean_summary = (_gone(c, r"^\s+|\s+$") for c in ("title", "summary"))
_short = f"substr({_gone(_gone(_replaced(_gone('summary', '<[^>]+>'), _ENTITIES), '\\s+', "' '"), '^\\s+|\\s+$')}, 1, 500)"
ORACLE_SQL["read_feed_xml"] = f"WITH {ARTICLES_SQL} SELECT 'feed' || (seq // 10) AS source, {_place}, {_clean_title} AS title, {_gone('url', r'^\s+|\s+$')} AS url, md5({_short}) AS summary_md5, coalesce(author, '') AS author, published FROM articles WHERE (seq // 10) % 11 <> 7"
_day = "CASE WHEN published LIKE 'Tue, %' THEN strftime(strptime(substr(published, 6, 11), '%d %b %Y'), '%Y-%m-%d') WHEN regexp_full_match(published, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN published ELSE '' END"
ORACLE_SQL["normalize_feed_entries"] = f"WITH {ARTICLES_SQL}, f AS (SELECT *, seq // 10 AS feed FROM articles) SELECT 'feed' || feed AS platform, {_place}, {_clean_title} AS title, {_day} AS published, CASE WHEN feed < 40 THEN 'AI技术' END AS category, CASE WHEN feed < 40 THEN CASE WHEN feed % 2 = 1 THEN 'direct' ELSE 'rsshub' END END AS source_type, CASE WHEN feed < 40 THEN '源' || feed END AS source_desc FROM f WHERE feed % 11 <> 7"
_RATED = f"WITH {ARTICLES_SQL}, {_INTEREST}, rated AS (SELECT a.* EXCLUDE (category), i.category, CAST(i.score AS DOUBLE) AS score FROM articles a JOIN interest i USING (seq))"
ORACLE_SQL["read_hot_list_json"] = f"{_RATED} SELECT {_place}, 'https://www.zhihu.com/question/' || seq AS url, title, author, CAST(seq * 7 AS VARCHAR) AS published, category, (CAST(round(score * 200) AS BIGINT) + CASE WHEN seq % 3 <> 0 AND seq % 1000 <> 0 THEN seq % 1000 ELSE seq % 77 END) / 100.0 AS raw_score, md5(summary) AS summary_md5 FROM rated WHERE score >= 2 AND title <> ''"
ORACLE_SQL["read_video_search_json"] = f"{_RATED} SELECT {_place}, 'https://www.bilibili.com/video/BV' || seq AS url, md5(trim(title)) AS title_md5, CAST(seq AS VARCHAR) AS published, category, (CAST(round(score * 200) AS BIGINT) + CASE WHEN seq % 2 = 0 THEN seq * 7 + (seq % 50) * 50 + (seq % 30) * 30 ELSE seq % 11 END) / 100.0 AS raw_score FROM rated WHERE score >= 2 AND trim(title) <> ''"
_names = "platform || ', ' || a.category || ', ' || repeat('x', 30)"
ORACLE_SQL["read_papers_json"] = f"WITH {ARTICLES_SQL}, {_INTEREST} SELECT CAST(a.seq % 10 AS INTEGER) AS pos, 'https://huggingface.co/papers/' || a.seq AS url, a.title, md5({_names.replace('platform', 'a.platform')} || ': ' || substr(a.summary, 1, 180)) AS summary_md5, {_names.replace('platform', 'a.platform')} AS author, CASE WHEN score < 1.5 THEN 'AI技术' ELSE i.category END AS category, CASE WHEN score < 1.5 THEN 3.0 ELSE CAST(score AS DOUBLE) END AS raw_score, CAST(a.seq % 9 AS VARCHAR) AS upvotes FROM articles a JOIN interest i USING (seq)"
_full = "'o' || seq || '/' || CASE WHEN seq % 3 = 0 THEN 'llm-kit' ELSE 'notes' END"
_escaped = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE_SQL["extract_repo_cards"] = f"""WITH {ARTICLES_SQL.replace('articles AS', 'base AS', 1)}, cards AS (SELECT *, {_full} AS name, {_gone(_escaped('substr(summary, 1, 90)'), '^\\s+|\\s+$')} AS d FROM base),
articles AS (SELECT * REPLACE (name || CASE WHEN d <> '' THEN ': ' || substr(d, 1, 80) ELSE '' END AS title, substr(substr(d, 1, 200) || CASE WHEN coalesce(author, '-') <> '' THEN ' [' || coalesce(author, '-') || ']' ELSE '' END, 1, 200) AS summary) FROM cards), {_INTEREST}
SELECT {_place}, 'https://github.com/' || name AS url, md5(substr(title, 1, 120)) AS title_md5, md5(summary) AS summary_md5, 'o' || seq AS author, greatest(CAST(score AS DOUBLE), 3.0) AS raw_score FROM articles JOIN interest USING (seq) WHERE {_hits('lower(title)', rules.AI_TOKENS)} > 0"""
_seen = lambda c: _gone(_gone(_escaped(c), "<[^>]+>"), r"^\s+|\s+$")
ORACLE_SQL["extract_news_cards"] = f"""WITH {ARTICLES_SQL.replace('articles AS', 'base AS', 1)}, articles AS (SELECT * REPLACE ({_seen('title')} AS title, {_seen('summary')} AS summary) FROM base), {_INTEREST}
SELECT {_place}, 'https://www.readaitime.com/news/' || seq AS url, md5(substr(title, 1, 120)) AS title_md5, md5(substr(summary, 1, 200)) AS summary_md5, i.category, CAST(score AS DOUBLE) AS raw_score FROM articles JOIN interest i USING (seq) WHERE length(title) >= 5 AND score >= 1.5"""
ORACLE_SQL["extract_search_hits"] = f"WITH {ARTICLES_SQL} SELECT CAST(seq // 10 AS VARCHAR) AS query, {_place}, 'https://w/' || seq AS url, md5({_seen('title')}) AS title_md5, md5(substr({_gone(_seen('summary'), '\\s+', "' '")}, 1, 200)) AS summary_md5, platform AS source FROM articles"
ORACLE_SQL["extract_account_article"] = rf"WITH {ARTICLES_SQL}, seen AS (SELECT *, {_seen('title')} AS t, {_gone(_gone(_escaped('content'), '\n{3,}', 'chr(10) || chr(10)'), r'^\s+|\s+$')} AS c FROM articles) SELECT CAST(seq AS VARCHAR) AS url, md5(t) AS title_md5, platform AS author, md5(c) AS content_md5, CAST(length(c) AS INTEGER) AS content_length FROM seen"
ORACLE_SQL["read_knowledge_list"] = f"WITH {ITEMS_SQL}, placed AS (SELECT *, seq // 20 AS page, row_number() OVER (PARTITION BY seq // 20 ORDER BY seq) - 1 AS pos FROM items) SELECT CAST(page AS VARCHAR) AS folder, CAST(pos AS INTEGER) AS pos, media_id, title, '1' AS media_type FROM placed WHERE coalesce(folder_id, '') = ''"
ORACLE_SQL["parse_notes"] = f"""WITH {_NOTES}, files AS (SELECT *, 'n' || CASE WHEN item_id % 4 = 3 THEN item_id - 1 ELSE item_id END AS name, CASE WHEN item_id % 4 = 3 THEN '_v2' ELSE '' END AS version FROM notes WHERE item_id % 9 <> 0 AND item_id % 10 <> 7),
last_ AS (SELECT *, '库/' || name || version || '.md' AS path FROM files QUALIFY row_number() OVER (PARTITION BY name ORDER BY '库/' || name || version || '.md' DESC) = 1)
SELECT path AS rel_path, name || version AS stem, name AS title, CASE WHEN item_id % 5 = 0 THEN '' ELSE array_to_string(tags, '|') END AS tags, md5(CASE WHEN item_id % 5 = 0 THEN '' ELSE '---' || chr(10) || 'tags: ["' || array_to_string(tags, '", "') || '"]' || chr(10) || '---' || chr(10) END || body) AS body_md5 FROM last_"""
ORACLE_SQL["candidate_queue"] = f"{_CURATED} SELECT knowledge_id, url, platform, template_id, 0.0 AS score, '' AS prompt, array_to_string(subs, '|') AS subdomains, array_to_string(tags, '|') AS tags, false AS content_fetched, CAST(length(content) AS INTEGER) AS full_content_len FROM curated"
ORACLE_SQL["queue_documents"] = f"""WITH {ARTICLES_SQL} SELECT CAST(seq AS VARCHAR) AS knowledge_id, coalesce(url, '') AS url, md5(coalesce(title, '')) AS title_md5, coalesce(platform, '') AS platform, (seq % 100) / 4.0 AS score,
    md5(coalesce('{{"title": "' || title || '"}} \\ }}{{', '')) AS prompt_md5, array_to_string([platform, category], '|') AS tags, md5(coalesce(content, '')) AS interpretation_md5, seq % 3 = 0 AS content_fetched, '' AS summary FROM articles"""
ORACLE_SQL["landed_sources"] = f"""SELECT 'hot_list' AS kind, CAST(pos AS BIGINT) AS pos, url, md5(title) AS title_md5, '知乎日报' AS platform, category, CAST(raw_score AS DOUBLE) AS raw_score, CAST(NULL AS VARCHAR) AS query FROM ({ORACLE_SQL["read_hot_list_json"]})
    UNION ALL SELECT 'papers', pos, url, md5(title), 'huggingface', category, raw_score, NULL FROM ({ORACLE_SQL["read_papers_json"]})
    UNION ALL SELECT 'search_hits', pos, url, title_md5, NULL, NULL, NULL, 'listing=' || query FROM ({ORACLE_SQL["extract_search_hits"]})"""
_said = " ".join(f"CASE WHEN {_hits('title' if where == 'title' else 'content', kws)} > 0 THEN {quoted(said)} END," for where, kws, said in rules.CONNECTIONS).rstrip(",")
ORACLE_SQL["source_labels"] = f"""WITH {ARTICLES_SQL} SELECT seq, {_label} AS label, CASE WHEN {_hits('title', ['短剧', '视频'])} > 0 OR contains(category, 'AIGC') THEN '抖音 / B站 / 小红书' WHEN {_hits('category', ['机器人', '硬件'])} > 0 THEN 'B站 / 公众号' WHEN {_hits('category', ['知识', '效率'])} > 0 THEN '小红书 / 公众号' ELSE '公众号 / 小红书' END AS publish_on,
  array_to_string(list_filter([{_said}], lambda x: x IS NOT NULL), '|') AS connections FROM articles"""
ORACLE_SQL["split_sentences"] = r"WITH " + ARTICLES_SQL + r", s AS (SELECT seq, string_split_regex(regexp_replace(content, '\s+', ' ', 'g'), '[。！？]') AS s FROM articles) SELECT seq, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM s"
ORACLE_SQL["digest_calendar"] = f"SELECT doc_id, ({_list(rules.WEEKDAYS)})[isodow(d)] AS weekday, strftime(d + 1, '%Y-%m-%d') AS next_run, strftime(d, '%Y-%m-%d') AS shown FROM (SELECT doc_id, DATE '{NOW}' + CAST(doc_id % 1000 AS INTEGER) AS d FROM documents)"
ORACLE_SQL["dedup_notes"] = f"WITH {_NOTES} SELECT regexp_replace(title, ' [0-9]+$', '') AS title, max(rel_path) AS rel_path FROM notes GROUP BY 1"
ORACLE_SQL["render_source_list"] = "SELECT string_agg('- **' || n_name || '** (`' || lower(n_name) || '`) — ' || CASE WHEN n_regionkey % 2 = 0 THEN 'direct' ELSE 'rsshub' END, chr(10) ORDER BY n_nationkey) AS body, count(*) AS n FROM nation"
ORACLE_SQL["stream_new_items"] = f"WITH {ITEMS_SQL} SELECT media_id, min(seq) AS seq FROM items WHERE folder_id IS NULL AND CAST(substr(media_id, 2) AS INTEGER) % 3 <> 0 GROUP BY 1"
_STREAMED = f"streamed AS {_depth_of("(SELECT doc_id AS seq, coalesce(text, '') AS content FROM documents)")}"
ORACLE_SQL["stream_score"] = f"WITH {_STREAMED} SELECT seq, CAST(score AS DOUBLE) AS score, {_level} AS level FROM streamed WHERE score >= 0.5"
ORACLE_SQL["stream_digest_batches"] = f"WITH {_STREAMED} SELECT {_level} AS level, count(*) AS n FROM streamed GROUP BY 1"

_garbage = f"(length({_strip('s')}) NOT BETWEEN 15 AND 150 OR regexp_matches(s, '[<>]') OR {_hits('lower(s)', rules.URL_TOKENS)} > 0 OR regexp_matches({_strip('s')}, {quoted(rules.ASCII_SENTENCE)}) OR NOT regexp_matches(s, '[一-鿿]') OR {_hits('lower(s)', rules.CODE_WORDS)} > 0)"
_weighed = lambda rows: "(" + " + ".join(f"{w} * {_hits('s', kws)}" for w, kws in rows) + ")"
ORACLE_SQL["extract_insights"] = rf"""WITH {ARTICLES_SQL}, fine AS (SELECT seq, title, list_filter(string_split_regex(regexp_replace(content, '\s+', ' ', 'g'), '[。！？]'), lambda s: NOT {_garbage}) AS s FROM articles),
rated AS (SELECT seq, title, list_transform(s, lambda s, i: {{'w': -{_weighed(rules.INSIGHT_WORDS)}, 'i': i, 's': s}}) AS a,
  list_transform(list_filter(s, lambda s: length(s) >= 20), lambda s, i: {{'w': -{_weighed(rules.THESIS_WORDS)}, 'i': i, 's': s}}) AS b FROM fine)
SELECT seq, coalesce(list_sort(list_filter(b, lambda r: r.w < 0))[1].s, '📄 ' || title) AS thesis, array_to_string(list_transform(list_sort(list_filter(a, lambda r: r.w <= -2))[1:5], lambda r: r.s), '|') AS insights FROM rated"""
_best = lambda n: f"best AS (SELECT *, CAST(row_number() OVER (ORDER BY raw_score DESC, seq) AS INTEGER) AS rank FROM ({_top(n)}))"
_filled2 = lambda a, b: f"coalesce(nullif({a}, ''), nullif({b}, ''), '')"
ORACLE_SQL["paper_rows"] = f"""{_WEIGHED}, {_best(400)}, rows_ AS (SELECT 0 AS part, rank, substr(title, 1, 50) AS title, {_filled2('author', 'platform')} AS org, substr({_filled2("CASE WHEN rank % 2 = 0 THEN title ELSE '' END", 'summary')}, 1, 60) AS point FROM best WHERE rank <= 200 AND platform IN ('huggingface', 'github')
UNION ALL SELECT 1, rank - 200, substr(title, 1, 50), substr(platform, 1, 15), coalesce(nullif(substr(summary, 1, 60), ''), '—') FROM best WHERE rank > 200 AND rank <= 215 AND {_hits('title', ['论文', '报告', '白皮书', '研究', 'arXiv', '发布.'])} > 0)
SELECT * FROM rows_ ORDER BY part, rank LIMIT 8"""
ORACLE_SQL["render_digest_sections"] = f"""{_WEIGHED}, {_best(20)} SELECT 'deep' AS section, '## 深度 {NOW}' || {_nl} || string_agg('### ' || title || {_nl} || '> ' || CASE WHEN rank > 1 THEN '论点 ' || title ELSE title END, {_nl} ORDER BY rank) AS body FROM best WHERE rank <= 5
UNION ALL SELECT 'brief', '## 快讯' || {_nl} || string_agg('- **' || title || '** — ' || platform, chr(10) ORDER BY rank) FROM best WHERE rank > 5"""
