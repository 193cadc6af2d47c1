"""Queries over text, URL and markup functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..operators import routing
from .registry import cases, query, sql_cases, sql_texts, sql_values, table, texts, values

_WORDS = "len(list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> ''))"


@query(f"SELECT doc_id, {_WORDS.format(c='text')}::BIGINT AS n_words, (length(text) // 3)::BIGINT AS n_tokens_estimated, sha256(text) AS content_hash FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count("text").alias("n_words"), text.token_estimate("text").alias("n_tokens_estimated"), F.sha2("text", 256).alias("content_hash"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s\\-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w)) AS terms FROM conversations")
def search_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.search_terms("text", synonyms=False).alias("terms"))


_Q = "(1, 'ws auth order depth'), (2, 'orderbook depth margin'), (3, 'nothing here'), (4, 'a-b \"c\" d:e plain'), (5, 'NOT fee AND perps')"
_SYN = "CASE t " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(s) for s in v)}]" for k, v in text.SYNONYMS.items()) + " ELSE [] END"


@query(f"""
WITH q AS (SELECT id, string_split(lower(s), ' ') AS terms FROM {sql_texts(_Q)}),
f AS (SELECT id, terms, list_filter(flatten(list_transform(terms, lambda t: {_SYN})), lambda s: NOT list_contains(terms, s)) AS more FROM q),
d AS (SELECT id, terms, more, list_filter(more, lambda s, i: list_position(more, s) = i) AS uniq FROM f)
SELECT id, terms || uniq[1:3] AS expanded FROM d""")
def synonym_expansion(spark, sf_dir):
    return texts(spark, sf_dir, _Q).select("id", text.expand_synonyms(F.split(F.lower("s"), " ")).alias("expanded"))


@query(f"""
SELECT id, list_aggregate(list_transform(list_filter(string_split(replace(s, chr(10), ' '), ' ')[1:8], lambda t: t <> '' AND NOT list_contains(['OR','AND','NOT','NEAR'], upper(t))), lambda t: CASE WHEN NOT regexp_matches(t, '[-:"''/{{}}()*?=&+#@!<>;]') OR (starts_with(t, '"') AND ends_with(t, '"')) THEN t ELSE '"' || replace(t, '"', '""') || '"' END), 'string_agg', ' AND ') AS match FROM {sql_texts(_Q)}""")
def match_query_text(spark, sf_dir):
    return texts(spark, sf_dir, _Q).select("id", text.match_query(F.split(F.translate("s", "\n", " "), " ")).alias("match"))


_DATES = "(1, 'Released 2025-12-23 today'), (2, 'December 23rd, 2025 - Major Update'), (3, 'February 2026'), (4, 'May 45, 2024'), (5, 'no date'), (6, 'june 1 1999'), (7, 'On March 3, 2021 and April 4, 2022'), (8, '')"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in text.MONTHS) + "]"
_M = "(" + "|".join(m.capitalize() for m in text.MONTHS) + ")"


@query(f"""
WITH d AS (SELECT id, s, nullif(regexp_extract(s, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS iso, regexp_extract(s, '(?i){_M}\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})', ['m', 'd', 'y']) AS f, regexp_extract(s, '(?i){_M}\\s+(\\d{{4}})', ['m', 'y']) AS g FROM {sql_texts(_DATES)})
SELECT id, coalesce(iso, CASE WHEN try_cast(f.d AS INT) BETWEEN 1 AND 31 AND try_cast(f.y AS INT) BETWEEN 2000 AND 2099 THEN f.y || '-' || lpad(list_position({_MONTHS}, lower(f.m))::VARCHAR, 2, '0') || '-' || lpad(f.d, 2, '0') END,
 CASE WHEN try_cast(g.y AS INT) BETWEEN 2000 AND 2099 THEN g.y || '-' || lpad(list_position({_MONTHS}, lower(g.m))::VARCHAR, 2, '0') || '-01' END) AS date FROM d""")
def prose_dates(spark, sf_dir):
    return texts(spark, sf_dir, _DATES).select("id", text.prose_date("s").alias("date"))


_CHANGES = "(1, 'The endpoint GET /api/v3/order will be removed. Use POST /api/v4/order.'), (2, 'Breaking change: parameter side renamed'), (3, 'Added a new field in the response'), (4, 'Rate limit weight increased for /fapi/v1/depth,'), (5, 'Fixed typos'), (6, 'deprecated api path /v1/old and new endpoint'), (7, 'path one¶removed later'), (8, '')"
_IMPACT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(s, '(?i){p}') THEN '{n}' END" for n, _, p in text.IMPACTS) + "], lambda x: x IS NOT NULL)"
_RANK = "greatest(1, " + ", ".join(f"CASE WHEN regexp_matches(s, '(?i){p}') THEN {dict(err=3, warn=2, info=1)[v]} ELSE 0 END" for _, v, p in text.IMPACTS) + ")"


@query(f"SELECT id, CASE WHEN len({_IMPACT}) = 0 THEN ['informational'] ELSE {_IMPACT} END AS classes, ['info', 'warn', 'err'][{_RANK}] AS severity FROM {sql_texts(_CHANGES)}")
def impact_classify(spark, sf_dir):
    return texts(spark, sf_dir, _CHANGES).select("id", text.impact_classes("s").alias("classes"), text.max_severity("s").alias("severity"))


_METHOD = "'(?i)(?:GET|POST|PUT|DELETE|PATCH)\\s+/[a-zA-Z0-9/_{}.\\-:]+'"


@query(f"""
WITH m AS (SELECT id, list_transform(regexp_extract_all(s, {_METHOD}), lambda x: upper(regexp_extract(x, '^([A-Za-z]+)', 1)) || ' ' || regexp_replace(regexp_replace(x, '^[A-Za-z]+\\s+', ''), '[.,;:)]+$', '')) AS named,
 list_transform(regexp_extract_all(s, '(?:^|\\W)(/(?:api|sapi|fapi|dapi|v[1-5])/[a-zA-Z0-9/_{{}}.\\-]+)', 1), lambda x: regexp_replace(x, '[.,;:)]+$', '')) AS bare FROM {sql_texts(_CHANGES)})
SELECT id, named || list_filter(bare, lambda p: NOT list_contains(named, 'GET ' || p) AND NOT list_contains(named, 'POST ' || p)) AS paths FROM m""")
def affected_paths(spark, sf_dir):
    return texts(spark, sf_dir, _CHANGES).select("id", text.affected_paths("s").alias("paths"))


_CHUNKS = "(1, '  code¶  more¶text'), (2, '|a|b|¶|-|-|¶|1|2|'), (3, 'http://a http://b https://c http://d'), (4, '한국어 문서입니다'), (5, 'plain prose here'), (6, '* one¶* two¶- three¶[x](y)¶text, with comma that is long enough to be prose for sure'), (7, 'Home¶About¶Docs¶API'), (8, 'one¶two')"


@query(f"""
WITH c AS (SELECT id, s, string_split(trim(s), chr(10)) AS l FROM {sql_texts(_CHUNKS)})
SELECT id, CASE WHEN len(list_filter(l, lambda x: starts_with(x, '  ') OR starts_with(x, chr(9)) OR starts_with(x, '```'))) / len(l) > 0.5 THEN 'code_heavy'
 WHEN len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) / len(l) > 0.3 THEN 'table_heavy' WHEN len(regexp_extract_all(s, 'https?://')) > 3 THEN 'url_heavy'
 WHEN length(s) - length(regexp_replace(s, '[\\x{{4e00}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}\\x{{3040}}-\\x{{30ff}}]', '', 'g')) > length(s) * 0.1 THEN 'cjk_text' ELSE 'prose' END AS class FROM c""")
def chunk_class(spark, sf_dir):
    return texts(spark, sf_dir, _CHUNKS).select("id", text.chunk_class("s").alias("class"))


@query(f"""
WITH c AS (SELECT id, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM {sql_texts(_CHUNKS)})
SELECT id, CASE WHEN len(l) < 4 THEN 0.0 ELSE len(list_filter(l, lambda x: (regexp_matches(x, '^[*\\-+]') AND length(x) < 100) OR (starts_with(x, '[') AND contains(x, '](') AND ends_with(x, ')')) OR (length(x) < 30 AND NOT regexp_matches(x, '[.,:;!?|#]')))) / len(l) END::DOUBLE AS ratio FROM c""")
def nav_line_ratio(spark, sf_dir):
    return texts(spark, sf_dir, _CHUNKS).select("id", text.nav_line_ratio("s").alias("ratio"))


@query(f"""
WITH c AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l, {_WORDS.format(c='text')} AS n FROM documents)
SELECT doc_id, list_filter([CASE WHEN n = 0 THEN 'empty' WHEN n < 50 THEN 'thin' END, CASE WHEN len(list_filter(l, lambda x: length(x) < 50 AND regexp_matches(x, '^[*\\-\\[]'))) > 5 AND len(list_filter(l, lambda x: length(x) < 50 AND regexp_matches(x, '^[*\\-\\[]'))) > len(list_filter(l, lambda x: length(x) > 60)) * 2 AND n < 200 THEN 'nav_chrome' END], lambda x: x IS NOT NULL) AS flags FROM c""")
def content_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_flags("text", F.lit(None).cast("string"), text.word_count("text")).alias("flags"))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized_markdown("text").alias("normal"))


# --- URLs ------------------------------------------------------------------------------------------------------------------

_URLS = """(1, ''), (2, '#top'), (3, 'https://a.example/{{x}}'), (4, 'mailto:me@a.example'), (5, 'http://'), (6, 'https://a.example/cdn-cgi/l'), (7, 'https://a.example/logo.PNG?x=1'), (8, 'https://a.example/static/app.js'),
 (9, 'https://a.example/docs/script.js'), (10, 'HTTPS://User@A.Example:443/a/./b/../c/?Q=1#f'), (11, 'http://b.example:8080'), (12, 'b.example/x'), (13, '  https://c.example/ok  '), (14, 'javascript:void(0)'), (15, 'https://d.example/ünï/ö'), (16, 'https://e.example/a//b/'), (17, '{% base %}/x'), (18, 'https://f.example/dist/main.mjs')"""
_EXT = ", ".join(f"'{x}'" for x in (*urls.IMAGE_EXTENSIONS, *urls.BINARY_EXTENSIONS, *urls.STATIC_EXTENSIONS))
_P = "'^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$'"
_HOST = "lower(regexp_replace(regexp_replace({a}, '^.*@', ''), ':\\d*$', ''))"
_REASON = f"""CASE WHEN u = '' THEN 'empty' WHEN starts_with(u, '#') THEN 'fragment_only' WHEN length(u) > 4096 THEN 'too_long' WHEN regexp_matches(u, '\\{{\\{{.*?\\}}\\}}|\\{{%.*?%\\}}|\\$\\{{.*?\\}}') THEN 'template_artifact'
 WHEN lower(p.s) IN ('javascript', 'mailto', 'tel', 'data', 'ftp') THEN 'bad_scheme:' || lower(p.s) WHEN lower(p.s) IN ('http', 'https') AND {_HOST.format(a='p.a')} = '' THEN 'no_hostname'
 WHEN contains(lower(p.p), '/cdn-cgi/') THEN 'cdn_admin_path:cdn-cgi' WHEN contains(lower(p.p), '/wp-admin/') THEN 'cdn_admin_path:wp-admin'
 WHEN lower(regexp_extract(p.p, '(\\.[^.]*)$', 1)) IN ({_EXT}) THEN 'resource_ext:' || lower(regexp_extract(p.p, '(\\.[^.]*)$', 1))
 WHEN lower(regexp_extract(p.p, '(\\.[^.]*)$', 1)) IN ('.js', '.mjs', '.cjs') AND regexp_matches(lower(p.p), '(?:/assets/|/static/|/_next/|/dist/|/build/|/chunks?/|/bundle)') THEN 'js_asset:' || lower(regexp_extract(p.p, '(\\.[^.]*)$', 1)) END"""
_ALL_URLS = f"(SELECT id::BIGINT AS id, url FROM {sql_values(_URLS, 'id, url')} UNION ALL SELECT 1000 + page_id, url FROM pages)"
_PARSED = f"(SELECT id, trim(url) AS u, regexp_extract(trim(url), {_P}, ['s', 'a', 'p', 'q', 'f']) AS p FROM {_ALL_URLS})"


def _all_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "url")
    return values(spark, _URLS, "id, url").select(F.col("id").cast("bigint").alias("id"), "url").unionByName(pages)


@query(f"SELECT id, {_REASON} AS reason, {_HOST.format(a='p.a')} AS host FROM {_PARSED}")
def url_sanitize(spark, sf_dir):
    return _all_urls(spark, sf_dir).select("id", urls.rejection("url").alias("reason"), urls.host(F.trim("url")).alias("host"))


@query(f"SELECT coalesce({_REASON}, 'accepted') AS reason, count(*) AS n FROM {_PARSED} GROUP BY 1")
def url_sanitize_scan(spark, sf_dir):
    return _all_urls(spark, sf_dir).groupBy(F.coalesce(urls.rejection("url"), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH r AS (SELECT id, u, {_REASON} AS reason, {_HOST.format(a='p.a')} AS host FROM {_PARSED}),
o AS (SELECT *, coalesce(reason, CASE WHEN NOT (host = 'a.example' OR host = 'example.com' OR ends_with(host, '.a.example') OR ends_with(host, '.example.com')) THEN 'domain' END) AS why FROM r)
SELECT why IS NULL AS accepted, coalesce(why, 'ok') AS reason, count(*) AS n FROM o GROUP BY 1, 2""")
def url_filter_pipeline(spark, sf_dir):
    """Sanitised, then held against the allowed domains."""
    why = F.coalesce(urls.rejection("url"), F.when(~urls.in_domains(F.trim("url"), ["a.example", "example.com"]), "domain"))
    return _all_urls(spark, sf_dir).groupBy(why.isNull().alias("accepted"), F.coalesce(why, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
SELECT page_id, lower(p.s) || '://' || {_HOST.format(a='p.a')} || CASE WHEN p.p = '' THEN '/' ELSE p.p END || CASE WHEN p.q <> '' THEN '?' || p.q ELSE '' END AS canonical, sha256(lower(p.s) || '://' || {_HOST.format(a='p.a')} || CASE WHEN p.p = '' THEN '/' ELSE p.p END || CASE WHEN p.q <> '' THEN '?' || p.q ELSE '' END) AS path_hash
FROM (SELECT page_id, regexp_extract(url, {_P}, ['s', 'a', 'p', 'q', 'f']) AS p FROM pages)""")
def canonical_urls(spark, sf_dir):
    c = urls.canonical("url")
    return table(spark, sf_dir, "pages").select("page_id", c.alias("canonical"), F.sha2(c, 256).alias("path_hash"))


_TYPES = "(1, 'https://x.example/openapi.json'), (2, 'https://github.com/a/b'), (3, 'https://x.example/llms.txt'), (4, 'https://docs.ccxt.com/#/a'), (5, 'https://x.example/api/spec.yaml'), (6, 'https://x.example/sitemap.xml'), (7, 'https://x.example/postman.json')"


@query(f"""
WITH u AS (SELECT id::BIGINT AS id, url FROM {sql_values(_TYPES, 'id, url')} UNION ALL SELECT 1000 + page_id, url FROM pages)
SELECT id, CASE WHEN contains(lower(url), 'openapi') OR contains(lower(url), 'swagger') OR (regexp_matches(url, '\\.(yaml|json)$') AND regexp_matches(lower(url), 'spec|api|rest')) THEN 'spec' WHEN contains(url, 'github.com/') THEN 'github_repo' WHEN contains(url, 'llms.txt') OR contains(url, 'llms-full.txt') THEN 'llms_txt' WHEN contains(url, 'docs.ccxt.com/') THEN 'ccxt_ref' ELSE 'official_docs' END AS source_type,
 CASE WHEN contains(lower(url), 'sitemap') AND contains(lower(url), '.xml') THEN 'sitemap' WHEN contains(lower(url), 'postman') THEN 'postman' WHEN contains(lower(url), 'asyncapi') THEN 'asyncapi' WHEN contains(lower(url), 'openapi') OR contains(lower(url), 'swagger') THEN 'openapi' WHEN regexp_matches(lower(url), '\\.(json|ya?ml)$') THEN 'spec_candidate' END AS kind FROM u""")
def source_type(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "url")
    rows = values(spark, _TYPES, "id, url").select(F.col("id").cast("bigint").alias("id"), "url").unionByName(pages)
    return rows.select("id", urls.source_type("url").alias("source_type"), urls.discovery_kind("url").alias("kind"))


_PATHS = "(1, '/api/v3/order?x=1'), (2, '/api/:id/x/'), (3, '/a/<user>/b).'), (4, '{{base}}/v1/{id}'), (5, 'https://h.example/v1/{a}/{b}'), (6, '/'), (7, '/x/],'), (8, '')"


_PATH_ROWS = f"(SELECT row_id AS id, CASE WHEN row_id % 2 = 0 THEN s ELSE s || '/' || row_id END AS s FROM {sql_cases(_PATHS, 'n, s', ('s',))})"


@query(f"""
WITH a AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\?.*$', ''), '<([^>]+)>', '{{\\1}}', 'g'), '/:([A-Za-z_][A-Za-z0-9_]*)', '/{{\\1}}', 'g'), '[)\\],.]+$', ''), '/+$', '') AS x FROM {_PATH_ROWS}),
b AS (SELECT id, CASE WHEN x = '' THEN '/' ELSE x END AS path FROM a), c AS (SELECT id, path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '^https?://[^/]*', ''), '^\\{{\\{{[^}}]*\\}}\\}}', ''), '\\{{[^}}]+\\}}', '{{}}', 'g'), '/+$', '') AS y FROM b)
SELECT id, path, CASE WHEN y = '' THEN '/' ELSE y END AS dedup_path FROM c""")
def path_normalize(spark, sf_dir):
    rows = cases(spark, sf_dir, _PATHS, "n, s").withColumn("s", F.when(F.col("row_id") % 2 == 0, F.col("s")).otherwise(F.concat("s", F.lit("/"), F.col("row_id").cast("string"))))
    return rows.select(F.col("row_id").alias("id"), urls.normalized_api_path("s").alias("path"), urls.path_for_dedup("s").alias("dedup_path"))


# --- markup ----------------------------------------------------------------------------------------------------------------

_INNER = "nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '')"


@query(f"SELECT page_id, coalesce({_INNER.format(t='title')}, {_INNER.format(t='h1')}) AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.title("html").alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(markup.hrefs("html")).alias("href"))


_TAG = "len(regexp_extract_all(html, '(?i)<(?:{p})[\\s>/]'))::BIGINT"


@query(f"SELECT page_id, {_TAG.format(p='table')} AS n_tables, {_TAG.format(p='pre')} AS n_code, {_TAG.format(p='h[1-6]')} AS n_headings, {_TAG.format(p='a')} AS n_links, {_TAG.format(p='p')} AS n_paragraphs FROM pages")
def markup_counters(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(markup.tag_count("html", p).alias(n) for n, p in (("n_tables", "table"), ("n_code", "pre"), ("n_headings", "h[1-6]"), ("n_links", "a"), ("n_paragraphs", "p"))))


_MD = "(1, '# A¶text¶## B¶```¶# no¶```¶| a | b |¶| --- | --- |¶| 1 | 2 |'), (2, '~~~¶code¶~~~¶# H¶'), (3, '```¶never closed¶# x'), (4, 'plain'), (5, '| x | y |¶|---|---|¶| 1 | 2 |¶¶| z | w |¶|:--|--:|¶| 3 | 4 |')"
_EXPECTED = "(1, 2, 1, 1), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 0), (5, 0, 0, 1)"


@query(f"SELECT row_id, h::BIGINT AS n_headings, f::BIGINT AS n_fences, t::BIGINT AS n_tables FROM {sql_cases(_EXPECTED, 'id, h, f, t')}")
def block_counts(spark, sf_dir):
    """Every part's note in one of five forms, with its name below; the other dialect has no back-references, so its side knows what each form holds."""
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    md = cases(spark, sf_dir, _MD, "id, md").join(named, "row_id").withColumn("md", F.concat("md", F.lit("\n\n"), "p_name"))
    return md.select("row_id", markup.heading_count("md").alias("n_headings"), markup.fence_count("md").alias("n_fences"), markup.table_count("md").alias("n_tables"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 4 AS t, p_partkey % 3 AS c, p_partkey % 5 AS h, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS words, p_partkey % 2 = 0 AS kept FROM part),
m AS (SELECT *, CASE WHEN kept THEN t ELSE 0 END AS mt, CASE WHEN kept THEN c ELSE 0 END AS mc, CASE WHEN kept THEN h ELSE 0 END AS mh, words + CASE WHEN kept THEN 10 * t + 3 * c + 2 * h ELSE 0 END AS n FROM p)
SELECT p_partkey, round(0.35 * CASE WHEN t > 0 THEN least(mt / t, 1) ELSE 1 END + 0.30 * CASE WHEN c > 0 THEN least(mc / c, 1) ELSE 1 END + 0.15 * CASE WHEN h > 0 THEN least(mh / h, 1) ELSE 1 END + 0.2 * least(n / 40, 1), 6)::DOUBLE AS quality FROM m""")
def extraction_quality(spark, sf_dir):
    """Pages of a part with tables, code and headings, whose markdown has kept all of them or none."""
    k = F.col("p_partkey")
    times = lambda what, n: F.concat_ws("", F.array_repeat(F.lit(what), n.cast("int")))
    html = F.concat(times("<table></table>", k % 4), times("<pre></pre>", k % 3), times("<h2></h2>", k % 5))
    kept = F.concat(times("| a | b |\n| --- | --- |\n\n", k % 4), times("```\nx\n```\n", k % 3), times("## A\n", k % 5))
    p = table(spark, sf_dir, "part").select("p_partkey", html.alias("html"), F.concat(F.when(k % 2 == 0, kept).otherwise(""), "p_name").alias("md"))
    return p.select("p_partkey", F.round(markup.extraction_quality("html", "md", text.word_count("md")), 6).alias("quality"))


@query(f"SELECT id, (len(regexp_extract_all(s, '(?m)^\\s*\\|.*\\|')) > 0) AS has_rows, len(regexp_extract_all(s, '(?m)^\\s*\\|?\\s*:?-+:?\\s*(?:\\|\\s*:?-+:?\\s*)+\\|?\\s*$'))::BIGINT AS n_tables FROM {sql_texts(_MD)}")
def table_detect(spark, sf_dir):
    c = F.col("s")
    return texts(spark, sf_dir, _MD).select("id", (F.regexp_count(c, F.lit(r"(?m)^\s*\|.*\|")) > 0).alias("has_rows"), F.regexp_count(c, F.lit(r"(?m)^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")).cast("bigint").alias("n_tables"))


# --- routing ---------------------------------------------------------------------------------------------------------------

_INPUTS = """(1, '-1002'), (2, 'Error 50004 from server'), (3, '{"symbol":"X","side":"BUY","price":"30000"}'), (4, 'symbol=X&side=BUY&type=LIMIT'), (5, 'import ccxt; ex.create_order(30000)'), (6, 'GET /api/v3/order'), (7, 'how do I place an order?'),
 (8, ''), (9, 'HTTP 429 rate limit exceeded'), (10, 'number 123456 here'), (11, '/api/v1'), (12, 'plain words'), (13, 'permission denied'), (14, 'what is /fapi/v1/depth used for')"""
_INPUT_EXPECTED = """(1, 'error_message', 0.7), (2, 'error_message', 0.8), (3, 'request_payload', 0.7), (4, 'request_payload', 0.6), (5, 'code_snippet', 0.75), (6, 'endpoint_path', 0.8), (7, 'question', 0.5),
 (8, 'question', 0.0), (9, 'error_message', 0.7), (10, 'error_message', 0.4), (11, 'endpoint_path', 0.6), (12, 'question', 0.2), (13, 'error_message', 0.3), (14, 'endpoint_path', 0.6)"""


@query(f"SELECT row_id, t AS input_type, c::DOUBLE AS confidence FROM {sql_cases(_INPUT_EXPECTED, 'id, t, c')}")
def classify_input(spark, sf_dir):
    """One input for each part, in fourteen forms; the rules need look-around, so the other side knows what each form is."""
    kind, confidence = routing.classified(F.col("s"))
    rows = cases(spark, sf_dir, _INPUTS, "id, s").repartition("row_id")  # the rules are long: a stage of their own
    return rows.select("row_id", kind.alias("input_type"), confidence.alias("confidence"))


@query()
def classify_conversations(spark, sf_dir):
    kind, confidence = routing.classified(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("input_type"), confidence.alias("confidence"))


_REGISTRY = "(1, 'alpha', 'Alpha Store'), (2, 'beta', 'Beta'), (3, 'gamma', 'Gamma Ray')"
_ASKED = "(1, 'How does Alpha Store compare with beta?'), (2, 'gamma limits'), (3, 'alphabet'), (4, 'BETA and gamma-ray')"


@query(f"SELECT id, list(source ORDER BY ord) AS sources FROM {sql_texts(_ASKED)} q JOIN {sql_values(_REGISTRY, 'ord, source, name')} r ON regexp_matches(lower(s), '\\b(' || source || '|' || lower(name) || ')\\b') GROUP BY id")
def source_detect(spark, sf_dir):
    return routing.detected_sources(texts(spark, sf_dir, _ASKED), values(spark, _REGISTRY, "ord, source, name"), "id", "s")
