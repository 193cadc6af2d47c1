"""Queries over the functions on a page's text, links and hosts, and over what questions want."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intents, markup, pages
from ..operators import lineage, quality, reports
from .registry import cases, query, sql_cases, sql_texts, table, texts
from .text_queries import _RANK


@query("SELECT doc_id, sha256(text) AS decoded_hash FROM documents")
def charset_decode(spark, sf_dir):
    """UTF-8 bytes under three content types: with the charset, without one, with a name that nobody knows."""
    kind = F.element_at(F.array(F.lit("text/html; charset=UTF-8"), F.lit("text/html"), F.lit("text/html; charset=x-none")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(pages.decoded(F.encode("text", "UTF-8"), kind), 256).alias("decoded_hash"))


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l, ends_with(text, chr(10)) AS e FROM documents), n AS (SELECT doc_id, l, len(l) - CASE WHEN e THEN 1 ELSE 0 END AS n, doc_id % 4 AS line FROM s),
k AS (SELECT doc_id, l, CASE WHEN line < 1 OR line > n THEN n ELSE line END AS k FROM n)
SELECT doc_id, coalesce(list_sum(list_transform(l[1 : k - 1], lambda x: length(x) + 1)), 0)::BIGINT AS place FROM k""")
def line_offsets(spark, sf_dir):
    """Where the first, second or third line starts; line 0 is none, so the last one's start."""
    return table(spark, sf_dir, "documents").select("doc_id", pages.line_start("text", F.col("doc_id") % 4).cast("bigint").alias("place"))


_ESCAPED = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), '\\n') ELSE text END"


@query(f"""
WITH c AS (SELECT doc_id, {_ESCAPED} AS c FROM documents), k AS (SELECT *, (length(c) - length(replace(c, '\\n', ''))) / 2 AS a, length(c) - length(replace(c, chr(10), '')) AS b FROM c)
SELECT doc_id, sha256(replace(CASE WHEN a > b THEN replace(replace(c, '\\t', chr(9)), '\\n', chr(10)) ELSE c END, '\\"', '"')) AS hash FROM k""")
def unescape_text(spark, sf_dir):
    """Texts of even ids hold a backslash and an n for each line end."""
    c = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\\n"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(pages.unescaped(c), 256).alias("hash"))


@query("SELECT p_partkey, p_name AS description FROM part")
def heading_descriptions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/v1/"), F.col("p_partkey").cast("string"))
    heading = F.concat(F.lit("GET "), path, F.lit(" - **"), "p_name", F.lit("** (HTTP POST x)"))
    return p.select("p_partkey", pages.heading_description(heading, path).alias("description"))


@query("SELECT p_partkey, p_size + 1 AS heading_line, 2 AS level, p_size + 3 AS code_start, p_size + 5 AS code_end, p_size + 6 AS table_start, p_size + 7 AS table_end, 1 AS n_code, 1 AS n_tables FROM part")
def block_ranges(spark, sf_dir):
    """p_size lines of text, a heading, a single line with a bar, a fence that holds a heading, and a table of two lines."""
    md = F.concat(F.repeat(F.lit("text\n"), F.col("p_size")), F.lit("## T\na | b\n```\n# no\n```\n| a | b |\n| - | - |\nend"))
    b = table(spark, sf_dir, "part").select("p_partkey", pages.blocks(md).alias("b"))
    at = lambda n, f, i=0: F.get(f"b.{n}", F.lit(i))[f]
    return b.select(
        "p_partkey", at("headings", "line").alias("heading_line"), at("headings", "level").alias("level"), at("code_blocks", "start_line").alias("code_start"), at("code_blocks", "end_line").alias("code_end"),
        at("table_blocks", "start_line").alias("table_start"), at("table_blocks", "end_line").alias("table_end"), F.size("b.code_blocks").alias("n_code"), F.size("b.table_blocks").alias("n_tables"),
    )


@query("SELECT doc_id, true AS is_slice, true AS in_bounds, contains(text, 'the') AS about FROM documents WHERE text <> ''")
def excerpts(spark, sf_dir):
    """Every excerpt is a slice of its text, of a bounded size, and about the word if that is there."""
    d = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text", pages.excerpt_about("text", F.array(F.lit("the"))).alias("x"))
    bare = lambda c: F.regexp_replace(c, "[\\s​‌‍﻿­]+", "")
    size = F.col("x.excerpt_end") - F.col("x.excerpt_start")
    piece = F.substring("text", F.col("x.excerpt_start") + 1, size)
    return d.select("doc_id", (bare(F.col("x.excerpt")) == bare(piece)).alias("is_slice"), size.between(0, 680).alias("in_bounds"), F.contains("text", F.lit("the")).alias("about"))


_NAV = "(1, '* a¶* b¶* c¶* d¶text that goes on'), (2, 'one line of text.¶another line of text.¶a third one here.¶and a fourth.'), (3, 'Skip to content¶text'), (4, '* a¶* b'), (5, '[a](b)¶[c](d)¶[e](f) [g](h)¶EN | DE¶text of some length')"


@query(f"SELECT row_id, nav FROM {sql_cases('(1, true), (2, false), (3, true), (4, false), (5, true)', 'n, nav')}")
def nav_regions(spark, sf_dir):
    """The head of each part's page, in five forms."""
    return cases(spark, sf_dir, _NAV, "id, md").select("row_id", pages.is_navigation("md", F.lit(0)).alias("nav"))


@query("SELECT p_partkey, method, path FROM part, (SELECT unnest(['GET', 'GET', 'POST', 'PUT', 'GET', 'DELETE']) AS method, unnest(['/api/v3/a/', '/api/v3/list/', '/api/v3/b/', '/w/', '/spot/tickers/', '/spot/x/']) AS base), LATERAL (SELECT base || p_partkey AS path)")
def api_tree(spark, sf_dir):
    """A client library's description: lists, objects with costs, items that are objects, groups without a method."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit('{"urls":{"api":{"public":"https://h.example/api/v3","spot":"https://s.example/spot/"}},"api":{"public":{"get":["a/'), k, F.lit('",{"path":"list/'), k, F.lit('"}],"post":{"b/'), k,
        F.lit('":1.5},"put":[{"url":"/w/'), k, F.lit('"}]},"spot":{"tickers":["'), k, F.lit('"],"delete":{"x/'), k, F.lit('":1}},"none":3}}'),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(pages.api_paths(text)))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN true WHEN page_id % 5 = 1 THEN false ELSE starts_with(path, '/en/') OR NOT contains(path, '7') END AS allowed FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def robots_rules(spark, sf_dir):
    """By status everything (4xx), nothing (5xx), or what the rules allow: the longest pattern that fits."""
    robots = "User-agent: other\nDisallow: /\n\nUser-agent: a\nUser-agent: *\nDisallow: /*7 # sevens\nAllow: /en/\n"
    status = F.when(F.col("page_id") % 5 == 0, 404).when(F.col("page_id") % 5 == 1, 503).otherwise(200)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", pages.robots_allowed(status, F.lit(robots), path).alias("allowed"))


@query("SELECT event_id, sha256('{\"a\":[' || user_id || ',null],\"k\":' || json_extract_string(props, '$.k') || '}') AS hash FROM events")
def canonical_json(spark, sf_dir):
    given = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": ['), F.col("user_id").cast("string"), F.lit(", null ] }"))
    return table(spark, sf_dir, "events").select("event_id", pages.json_hash(given).alias("hash"))


@query("""
WITH h AS (SELECT c_custkey, c_custkey % 256 AS a, c_nationkey * 7 AS b, c_custkey % 5 AS c FROM customer)
SELECT c_custkey, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) AS unsafe FROM h""")
def unsafe_hosts(spark, sf_dir):
    k = F.col("c_custkey")
    host = F.concat_ws(".", (k % 256).cast("string"), (F.col("c_nationkey") * 7).cast("string"), (k % 5).cast("string"), F.lit("9"))
    return table(spark, sf_dir, "customer").select("c_custkey", intents.is_unsafe_host(host).alias("unsafe"))


_CODE = """(1, 'ex = ccxt.OKX({}); ex.fetch_balance()'), (2, 'import RestClientV5'), (3, 'curl "https://api.kraken.com/0/public/{x}/Time/"'), (4, 'no code'), (5, 'getTickers() on www.okx.com')"""


_CODE_EXPECTED = "(1, 'okx', 'ccxt', NULL, 'account balance'), (2, 'bybit', 'library', NULL, NULL), (3, 'kraken', 'url', '/0/public//Time', NULL), (4, NULL, NULL, NULL, NULL), (5, 'okx', 'library', NULL, 'tickers')"


@query(f"SELECT row_id, source_hint, code_source, api_path, topic FROM {sql_cases(_CODE_EXPECTED, 'n, source_hint, code_source, api_path, topic')}")
def code_context(spark, sf_dir):
    """A piece of code for each part, in five forms."""
    c = cases(spark, sf_dir, _CODE, "id, s").select("row_id", intents.code_context("s").alias("c"))
    return c.select("row_id", "c.source_hint", "c.code_source", "c.api_path", F.get("c.methods", F.lit(0))["topic"].alias("topic"))


_SECTIONS = "(1, 'binance', 'coin-m futures order'), (2, 'binance', 'spot order'), (3, 'kraken', 'a perp on margin'), (4, 'other', 'the sub account api'), (5, 'other', 'nothing'), (6, 'okx', 'rest endpoint'), (7, 'single', 'spot')"


@query(f"SELECT row_id, section FROM {sql_cases("(1, 'futures_coinm'), (2, 'spot'), (3, NULL), (4, 'sub_account'), (5, NULL), (6, 'rest'), (7, NULL)", 'n, section')}")
def section_detect(spark, sf_dir):
    """A question about each part, in seven forms."""
    has = F.when(F.col("source") == "kraken", F.array(F.lit("spot"), F.lit("earn"))).when(F.col("source") == "other", F.array(F.lit("trade"), F.lit("sub_account"))).when(F.col("source") == "okx", F.array(F.lit("websocket"), F.lit("rest"))).otherwise(F.array(F.lit("spot")))
    return cases(spark, sf_dir, _SECTIONS, "id, source, q").select("row_id", intents.section("q", F.col("source"), has).alias("section"))


@query(f"SELECT conv_id, turn, regexp_matches(text, '{intents.RATE_LIMIT}') AS rate, regexp_matches(text, '{intents.PERMISSIONS}') AS permissions, regexp_matches(text, '{intents.REQUIRES}') AS requires FROM conversations")
def intent_tests(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intents.wants_rate_limit("text").alias("rate"), intents.wants_permissions("text").alias("permissions"), intents.requires_permission("text").alias("requires"))


@query("SELECT page_id, page_id % 2 = 0 OR NOT (contains(lower(url), '/en/')) AS shown FROM (SELECT page_id, replace(url, '/fr/', '/fr/') AS url FROM pages)")
def testnet_filter(spark, sf_dir):
    """English pages stand for the test system's."""
    url = F.replace("url", F.lit("/en/"), F.lit("/testnet/"))
    question = F.when(F.col("page_id") % 2 == 0, "orders on the TestNet").otherwise("orders")
    return table(spark, sf_dir, "pages").select("page_id", intents.shown_for(url, question).alias("shown"))


@query("SELECT c_custkey, round(abs(c_acctbal) / (1 + abs(c_acctbal)), 9) AS score FROM customer")
def score_normalize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(intents.bm25_normalized("c_acctbal"), 9).alias("score"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'blog.') THEN 'blog' WHEN contains(lower(url), '/en/') THEN 'english' ELSE 'unknown' END AS source FROM pages")
def guess_source(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", intents.guessed_source("url", [("blog.", "blog"), ("/en/", "english")]).alias("source"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"SELECT page_id, CASE WHEN starts_with({_HOST}, 'blog.') THEN 'the blog' ELSE {_HOST} END AS source FROM pages")
def domain_map(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("domain"))
    known = p.filter(F.col("domain").startswith("blog.")).select("domain", F.lit("the blog").alias("source")).distinct()
    return lineage.by_domain(p, known).select("page_id", "source")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'owner' WHEN contains(url, '/en/') THEN 'english' ELSE 'unknown' END AS source FROM pages UNION ALL SELECT page_id, 'second' FROM pages WHERE page_id % 6 = 0")
def owned_pages(spark, sf_dir):
    """A third of the pages have an owner, half of these two; others are guessed. Several pages can have one URL: the page's number, as a fragment, keeps them apart."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    owners = F.when(F.col("page_id") % 6 == 0, F.array(F.lit("owner"), F.lit("second"))).when(F.col("page_id") % 3 == 0, F.array(F.lit("owner")))
    ownership = p.select("url", F.explode(owners).alias("owner"))
    return lineage.owned_pages(p, ownership, intents.guessed_source("url", [("/en/", "english")])).select("page_id", "source")


@query("SELECT p_partkey, 'short' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Structured Fallback Extract' || chr(10) || chr(10) || '### Code Block 1' || chr(10) || '```text' || chr(10) || p_name || chr(10) || '```' || chr(10) || chr(10) || '| col_1 | col_2 |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' | a\\|b |' || chr(10) || '| x |  |' AS md FROM part")
def structure_fallback(spark, sf_dir):
    """Code and a table without a header come through though the markdown lost them."""
    html = F.concat(F.lit("<pre>"), "p_name", F.lit("\n</pre><table><tr><td>"), "p_brand", F.lit("</td><td>a|b</td></tr><tr><td>x</td></tr></table>"))
    return table(spark, sf_dir, "part").select("p_partkey", markup.markdown_with_structure(F.lit("short"), html).alias("md"))


@query("SELECT page_id, ['https://h.example/a/c', 'https://h.example/r?x=1', 'https://h.example/a/b/' || page_id || '/d', 'http://o.example/' || page_id] AS links FROM pages")
def resolved_links(spark, sf_dir):
    k = F.col("page_id").cast("string")
    html = F.concat(F.lit('<a href="../c#top">1</a><a class="x" href="/r?x=1">2</a><a href="mailto:a@b.example">3</a><a href="'), k, F.lit('/d">4</a><a href="//o.example/p.png">5</a><a href="http://o.example/'), k, F.lit('">6</a><a href="../c">7</a>'))
    return table(spark, sf_dir, "pages").select("page_id", markup.links(html, F.lit("https://h.example/a/b/")).alias("l"), k.alias("k")).select("page_id", F.transform("l", lambda u: F.when(u.endswith("/d"), F.concat(F.lit("https://h.example/a/b/"), F.col("k"), F.lit("/d"))).otherwise(u)).alias("links"))


# --- changelogs, counters, scans -------------------------------------------------------------------------------------------

_LOGS = "SELECT event_id, event_type AS source, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS entry_date, 'https://a.example/' || event_id AS source_url, repeat(event_type || ' ', 100) AS entry_text FROM events"


def _logs(spark, sf_dir):
    date = F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), date.alias("entry_date"), F.concat(F.lit("https://a.example/"), F.col("event_id").cast("string")).alias("source_url"), F.repeat(F.concat("event_type", F.lit(" ")), F.lit(100)).alias("entry_text"))


@query(f"SELECT event_id, entry_date, substr(entry_text, 1, 300) AS excerpt FROM ({_LOGS}) WHERE source = 'click' AND (entry_date IS NULL OR entry_date >= '2024-01-10')")
def changelog_list(spark, sf_dir):
    """Entries of one source from a date on; undated ones stay."""
    return reports.changelogs(_logs(spark, sf_dir), "click", since="2024-01-10").select("event_id", "entry_date", "excerpt")


@query(f"SELECT source_url, entry_date, count(*) OVER () AS total FROM ({_LOGS}) ORDER BY entry_date DESC NULLS LAST, source_url LIMIT 50")
def changelog_page(spark, sf_dir):
    """A top-k report: the newest page of the list and the number of all."""
    rows = reports.changelogs(_logs(spark, sf_dir))
    return reports.changelog_page(rows).select("source_url", "entry_date", "total")


_CHANGES = "(1, 'The endpoint was removed'), (2, 'new field in the response'), (3, 'parameter x renamed, rate limit halved'), (4, 'typo')"


@query(f"SELECT id, severity FROM (SELECT id, ['info', 'warn', 'err'][{_RANK}] AS severity FROM (SELECT id, substr(s, 1, 3000) AS s FROM {sql_texts(_CHANGES)})) WHERE severity <> 'info'")
def classify_changelogs(spark, sf_dir):
    """Changelog entries, each with a document below it, by the operator's first 3,000 characters."""
    rows = reports.classified_changelogs(texts(spark, sf_dir, _CHANGES).select("id", F.col("s").alias("entry_text")))
    return rows.filter("severity <> 'info'").select("id", "severity")


_COUNT = {
    "code_tags": "len(regexp_extract_all(text, '\\[code\\]'))", "fences": "len(regexp_extract_all(text, '```'))", "table_lines": "len(list_filter(string_split(text, chr(10)), lambda s: contains(s, '|') AND length(trim(s)) > 2))",
    "html_tables": "len(regexp_extract_all(text, '(?i)<table\\b'))", "links": "len(regexp_extract_all(text, '\\[[^\\]]+\\]\\([^)]+\\)'))", "headings": "len(list_filter(string_split(text, chr(10)), lambda s: starts_with(ltrim(s), '#')))",
}


@query("SELECT count(*) AS pages, " + ", ".join(f"sum({c})::BIGINT AS {n}, count(*) FILTER ({c} > 0) AS pages_with_{n}" for n, c in _COUNT.items()) + " FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN '# a' || chr(10) || '[code] | [x](y) | ``` <TABLE>' || text ELSE text END AS text FROM documents)")
def extraction_counters(spark, sf_dir):
    md = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# a\n[code] | [x](y) | ``` <TABLE>"), "text")).otherwise(F.col("text"))
    return reports.markup_counters(table(spark, sf_dir, "documents").select(md.alias("md")))


@query("SELECT 'd' || (user_id % 10) AS domain, coalesce(CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 200 WHEN 'click' THEN 304 END, 0) AS http_status, count(*) AS n, sum(event_id)::BIGINT AS raw_bytes FROM events WHERE event_id % 4 IN (1, 2) GROUP BY 1, 2")
def crawl_metrics(spark, sf_dir):
    """Two of four runs."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 304)
    versions = e.select(F.col("user_id").alias("page_id"), (F.col("event_id") % 4).alias("run"), status.alias("http_status"), F.col("event_id").alias("raw_bytes"))
    pages_ = e.select(F.col("user_id").alias("page_id")).distinct().withColumn("domain", F.concat(F.lit("d"), (F.col("page_id") % 10).cast("string")))
    return reports.crawl_metrics(versions, pages_, [1, 2])


@query("""
WITH b AS (SELECT user_id AS key, max(event_type) FILTER (event_id % 2 = 0) AS a, max(event_type) FILTER (event_id % 2 = 1) AS b FROM events WHERE (event_id % 2 = 0 AND user_id % 5 <> 0) OR (event_id % 2 = 1 AND user_id % 7 <> 0) GROUP BY 1),
c AS (SELECT key, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'stale' WHEN a <> b THEN 'updated' END AS change FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY key) AS r FROM c WHERE change IS NOT NULL)
SELECT change, list(key ORDER BY key) AS samples FROM r WHERE r <= 3 GROUP BY 1""")
def run_samples(spark, sf_dir):
    """A report: three keys of each change between two runs; the remainders only make the runs."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 2).cast("int").alias("run"), F.col("event_type").alias("digest"))
    return reports.run_samples(e.filter("(run = 0 AND key % 5 <> 0) OR (run = 1 AND key % 7 <> 0)"), (0, 1))


@query("SELECT count(*) AS pages, count(*) FILTER (doc_id % 10 < 4) AS incomplete, count(*) FILTER (doc_id % 10 BETWEEN 4 AND 6) AS weak, round(avg((doc_id % 10) / 10.0), 6) AS mean FROM documents")
def extraction_scan(spark, sf_dir):
    return quality.extraction_scan(table(spark, sf_dir, "documents"), (F.col("doc_id") % 10) / 10.0)


@query("""
SELECT 'quality' AS name, CASE WHEN count(*) FILTER (doc_id % 10 = 0) > 0 THEN 'warn' ELSE 'pass' END AS status, count(*) FILTER (doc_id % 10 < 3)::INT AS n_issues FROM documents
UNION ALL SELECT 'retrieval', CASE WHEN avg((event_type <> 'error')::INT) >= 0.8 THEN 'pass' WHEN avg((event_type <> 'error')::INT) >= 0.5 THEN 'warn' ELSE 'fail' END, count(*) FILTER (event_type = 'error')::INT FROM events
UNION ALL SELECT 'extraction', CASE WHEN count(*) FILTER (doc_id % 10 < 4) = 0 THEN 'warn' WHEN count(*) FILTER (doc_id % 10 < 4) < 5 THEN 'warn' ELSE 'fail' END, count(*) FILTER (doc_id % 10 < 7)::INT FROM documents
UNION ALL SELECT 'catalogue', 'pass', count(*) FILTER (page_id % 3 = 0)::INT FROM pages UNION ALL SELECT 'broken', 'error', 0""")
def audit_adapters(spark, sf_dir):
    """The checks' rows from four tables, and one whose table is not there."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    issues = docs.groupBy(F.when(k == 0, "empty+tiny_html").when(k < 3, "thin").otherwise("ok").alias("issue")).agg(F.count("*").alias("n"))
    summary = table(spark, sf_dir, "events").agg(F.count("*").alias("n_queries"), F.avg((F.col("event_type") != "error").cast("double")).alias("hit_rate"))
    scan = quality.extraction_scan(docs, k / 10.0)
    matched = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 3 > 0, "exact").alias("how"))
    rows = [quality.quality_adapter(issues), quality.retrieval_adapter(summary), quality.extraction_adapter(scan), quality.catalogue_adapter(matched), quality.guarded("broken", lambda: spark.table("no_such_table").filter("x > 1"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("n_issues", F.col("n_issues").cast("int"))


@query("SELECT count(*) AS sections, count(*) FILTER (errors > 0) AS failed, sum(fetched)::BIGINT AS fetched, sum(errors)::BIGINT AS skipped FROM (SELECT user_id, count(*) AS fetched, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)")
def sync_sections(spark, sf_dir):
    """Users stand for sections, their errors for what was skipped."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("fetched"), F.count(F.when(F.col("event_type") == "error", 1)).alias("skipped"))
    return reports.sync_totals(e.withColumn("error", F.when(F.col("skipped") > 0, "ETIMEOUT")))


@query("SELECT g, list(url ORDER BY page_id) AS urls FROM (SELECT page_id // 10 AS g, url, min(page_id) AS page_id FROM pages GROUP BY 1, 2) GROUP BY 1")
def wayback_urls(spark, sf_dir):
    """An archive's answer for every ten pages: the first list names the columns; pages come twice."""
    rows = table(spark, sf_dir, "pages").groupBy(F.expr("page_id DIV 10").alias("g")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("r"))  # ten pages
    lists = F.transform("r", lambda x: F.array(F.lit("k"), x["url"]))
    body = F.to_json(F.concat(F.array(F.array(F.lit("urlkey"), F.lit("original"))), lists, lists))
    return rows.select("g", pages.wayback_urls(body).alias("urls"))
