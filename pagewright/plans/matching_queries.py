"""Queries over path matching, payloads and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, reports
from .registry import cases, query, sql_cases, table

_CAT = "(1, '/api/v3/order§', 'GET'), (2, '/v1/{id}/x§', 'GET'), (3, '/v2/spot§/:sym', 'GET'), (4, '/v9/none§', 'GET')"
_REC = "(1, '/api/v3/order§/', 'GET'), (2, 'https://h.example/v1/<x>/x§', 'GET'), (3, '/v4/spot§/{s}', 'POST'), (4, '/other§', 'GET')"
_XREF = "(1, '/api/v3/order§', '/api/v3/order§', 'exact', true), (2, '/v1/{}/x§', '/v1/{}/x§', 'exact', true), (3, '/v2/spot§/{}', '/v4/spot§/{}', 'suffix', false), (4, '/v9/none§', NULL, NULL, NULL), (4, NULL, '/other§', NULL, NULL)"


@query(f"SELECT cat_path, rec_path, how, methods_agree FROM {sql_cases(_XREF, 'n, cat_path, rec_path, how, methods_agree', ('cat_path', 'rec_path'), n=4)}")
def path_cross_reference(spark, sf_dir):
    """A catalogue entry and a record for each part: the same path, the same but for its parameter's name, the same but for its version, or different ones."""
    return matching.cross_reference(cases(spark, sf_dir, _CAT, "n, path, method").select("path", "method"), cases(spark, sf_dir, _REC, "n, path, method").select("path", "method"))


@query("SELECT p_partkey AS record_id, CASE p_partkey % 3 WHEN 0 THEN 'https://a.example/docs/order' ELSE 'https://a.example/spot' END || p_partkey AS url, CASE p_partkey % 3 WHEN 0 THEN 44 ELSE 43 END AS score FROM part WHERE p_partkey % 3 < 2")
def documentation_urls(spark, sf_dir):
    """A record for each part; a third of them have three pages that name them, a third one, a third none."""
    key, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    path = F.concat(F.when(k == 0, "/api/v3/order").when(k == 1, "/v1/spot/trade").otherwise("/gone"), n)
    page = lambda where, url, md: p.filter(where).select(F.concat(F.lit(f"https://a.example/{url}"), n).alias("url"), md.alias("md"))
    pages = page(k == 0, "docs/order", F.concat(F.lit("GET /api/v3/order"), n, F.lit(" places one"))).unionByName(page(k == 0, "faq", F.concat(F.lit("see /api/v3/order"), n)))
    pages = pages.unionByName(page(k == 0, "changelog", F.concat(F.lit("/api/v3/order"), n, F.lit(" added")))).unionByName(page(k == 1, "spot", F.concat(F.lit("/v1/spot/trade"), n, F.lit(" here"))))
    return matching.documentation_urls(p.select(key.alias("record_id"), path.alias("path")), pages)


_PAYLOADS = """(1, '{"symbol":"X§","side":"BUY","type":"LIMIT","quantity":1}'), (2, '{"instId":"X§","side":"buy","ordType":"limit"}'), (3, '{"coin":"a§","address":"b","amount":1}'), (4, 'not json §'), (5, '{"leverage":5,"symbol":"X§"}'), (6, '{"a":§}')"""
_PAYLOADS_EXPECTED = "(1, 'place order', 'binance'), (2, 'place order', 'okx'), (3, 'withdraw', NULL), (4, NULL, NULL), (5, 'set leverage', NULL), (6, NULL, NULL)"


@query(f"SELECT row_id, action, source FROM {sql_cases(_PAYLOADS_EXPECTED, 'n, action, source')}")
def payload_routing(spark, sf_dir):
    """A payload about each part, in six forms."""
    return cases(spark, sf_dir, _PAYLOADS, "n, s").select("row_id", matching.payload_action(F.col("s")).alias("action"), matching.payload_source(F.col("s")).alias("source"))


@query("""
WITH f AS (SELECT url, 'a' AS method FROM pages UNION ALL SELECT url, 'b' FROM pages WHERE page_id < 3)
SELECT list_filter([CASE WHEN (SELECT count(*) FROM f) = 0 THEN 'all_methods_failed' END, CASE WHEN (SELECT count(DISTINCT url) FROM f WHERE method = 'a') > 10 * (SELECT count(DISTINCT url) FROM f WHERE method = 'b') AND (SELECT count(DISTINCT url) FROM f WHERE method = 'b') < 20 THEN 'method_divergence' END,
 CASE WHEN (SELECT count(DISTINCT url) FROM f) < 50 AND (SELECT count(DISTINCT url) FROM f) - (SELECT count(DISTINCT url) FROM f WHERE method = 'b') > 0.5 * (SELECT count(DISTINCT url) FROM f) THEN 'low_cross_validation' END], lambda x: x IS NOT NULL) AS warnings""")
def discovery_warnings(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    found = p.select("url", F.lit("a").alias("method")).unionByName(p.filter("page_id < 3").select("url", F.lit("b").alias("method")))
    return reports.discovery_warnings(found, p)


@query("SELECT event_type AS url, list_sort(list(DISTINCT CASE WHEN user_id % 2 = 0 THEN 'sitemap' ELSE 'openapi' END)) AS kinds, list_sort(list(DISTINCT user_id::VARCHAR))[1:5] AS evidences FROM events GROUP BY 1")
def discovered_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reports.discovered_sources(e.select(F.col("event_type").alias("url"), F.when(F.col("user_id") % 2 == 0, "sitemap").otherwise("openapi").alias("kind"), F.col("user_id").cast("string").alias("evidence")))


@query("SELECT count(*) AS total, count(*) FILTER (date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') > 365) AS stale FROM orders")
def stale_sitemap_entries(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("lastmod"))
    return reports.stale_sitemap_entries(entries, F.lit("2000-01-01").cast("timestamp"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' ORDER BY created_at DESC, id DESC LIMIT 50")
def review_list(spark, sf_dir):
    """A top-k report."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return reports.review_list(q, "O").select("id", "created_at")
