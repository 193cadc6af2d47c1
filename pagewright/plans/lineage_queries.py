"""Queries over citations, upserts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import lineage, quality
from .registry import query, table


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus <> 'P') USING (l_orderkey)")
def missing_source(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    pages = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lineage.missing_sources(cited, pages, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus AS current_hash FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus IS NOT NULL AND l_linestatus <> o_orderstatus")
def stale_citation(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_url"), "l_linenumber", F.col("l_linestatus").alias("doc_hash"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_url"), F.col("o_orderstatus").alias("doc_hash"))
    return lineage.stale_citations(cited, pages).select(F.col("doc_url").alias("l_orderkey"), "l_linenumber", "current_hash")


@query("SELECT k, 'left' AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) ANTI JOIN (SELECT o_custkey + 100 AS k FROM orders) USING (k) UNION ALL SELECT k, 'right' FROM (SELECT DISTINCT o_custkey + 100 AS k FROM orders) ANTI JOIN (SELECT c_custkey AS k FROM customer) USING (k)")
def orphans_both_ways(spark, sf_dir):
    """Keys that are a hundred apart, so that both sides have some of their own."""
    return lineage.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("k")), "k")


_UPSERT = """
WITH cur AS (SELECT user_id AS url, arg_max(event_type, event_id) AS digest FROM events WHERE event_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY 1),
inc AS (SELECT user_id AS url, arg_max(event_type, event_id) AS digest, max(event_id) AS run FROM events WHERE event_id % 2 = 1 AND user_id % 7 <> 0 GROUP BY 1),
up AS (SELECT coalesce(c.url, i.url) AS url, coalesce(i.digest, c.digest) AS digest, CASE WHEN i.url IS NOT NULL THEN c.digest END AS prev_digest, coalesce(i.run, 0) AS run, CASE WHEN i.url IS NULL THEN 'kept' WHEN c.url IS NULL THEN 'new' WHEN c.digest <> i.digest THEN 'updated' ELSE 'unchanged' END AS action FROM cur c FULL JOIN inc i ON c.url = i.url)"""


def _upserted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_type").alias("digest"), F.col("event_id").alias("run"))
    cur = e.filter("run % 2 = 0 AND url % 5 <> 0").groupBy("url").agg(F.max_by("digest", "run").alias("digest"), F.lit(0).cast("bigint").alias("run"))
    return lineage.page_upsert(cur, e.filter("run % 2 = 1 AND url % 7 <> 0"))


@query(_UPSERT + " SELECT * FROM up")
def page_upsert(spark, sf_dir):
    """A batch (odd events) comes upon a snapshot (even ones); the remainders only make the two."""
    return _upserted(spark, sf_dir)


@query(_UPSERT + " SELECT DISTINCT event_id % 100 AS record_id, event_type AS field_name FROM events e SEMI JOIN (SELECT url, prev_digest FROM up WHERE action = 'updated') u ON e.user_id = u.url AND e.event_type = u.prev_digest")
def source_changed(spark, sf_dir):
    cited = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_type").alias("doc_hash"), (F.col("event_id") % 100).alias("record_id"), F.col("event_type").alias("field_name"))
    return lineage.invalidated(_upserted(spark, sf_dir), cited)


@query("""
WITH a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'add' WHEN b.doc_id IS NULL THEN 'remove' ELSE 'replace' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h""")
def incremental_diff(spark, sf_dir):
    """An index of an older state against the pages of now; the remainders only make the two states."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = d.filter("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return lineage.incremental_diff(old, d.filter("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


@query("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN sha256('other') ELSE sha256(text) END AS content_hash, 3 AS a, CASE WHEN doc_id % 6 = 2 THEN 3 WHEN doc_id % 6 = 3 THEN length(text) + 5 ELSE 13 END AS z, CASE WHEN doc_id % 6 = 4 THEN 'altered' ELSE substr(text, 4, 10) END AS excerpt FROM documents)
SELECT c.doc_id, CASE WHEN z <= a THEN 'EBADRANGE' WHEN length(excerpt) > 600 THEN 'ETOOLONG' WHEN d.doc_id IS NULL THEN 'ENOPAGE' WHEN content_hash <> sha256(text) THEN 'EHASH' WHEN text = '' THEN 'ENOTEXT' WHEN z > length(text) THEN 'EBOUNDS' WHEN substr(text, a + 1, (z - a)::BIGINT) <> excerpt THEN 'EEXCERPT' END AS error
FROM c LEFT JOIN (SELECT * FROM documents WHERE doc_id % 13 <> 0) d ON c.doc_id = d.doc_id""")
def citation_verify(spark, sf_dir):
    """Excerpts of every document, some of them spoilt; some pages are gone."""
    d, k = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 6
    end = F.when(k == 2, 3).when(k == 3, F.length("text") + 5).otherwise(13)
    cited = d.select("doc_id", F.when(k == 1, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"), F.lit(3).alias("excerpt_start"), end.alias("excerpt_end"), F.when(k == 4, "altered").otherwise(F.substring("text", 4, 10)).alias("excerpt"))
    pages = d.filter("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("page_hash"), F.col("text").alias("page_text"))
    return lineage.verify_citations(cited, pages).select("doc_id", "error")


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 0 AND text <> ''")
def hash_verify(spark, sf_dir):
    """Texts of every ninth id lost their last character since their hash was stored."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), "text")
    stored = d.select("url", F.sha2("text", 256).alias("content_hash"))
    bodies = d.select("url", F.when(F.col("doc_id") % 9 == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")).alias("markdown"))
    found = lineage.fsck(stored, bodies, d.select("url"), d.select(F.col("url").alias("record_id"), F.lit("{}").alias("record")))
    return found.filter("check = 'hash_mismatch'").select(F.col("key").cast("bigint").alias("doc_id"))


_W = "len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))"


@query(f"""
WITH p AS (SELECT doc_id, {_W} AS w, n_chars AS size, CASE WHEN doc_id % 17 = 0 THEN 403 ELSE 200 END AS status, CASE WHEN doc_id % 3 = 0 THEN n_chars / 2 END AS prev, CASE WHEN doc_id % 5 = 0 THEN 0.3 ELSE 0.9 END AS q, doc_id % 4 = 0 AS gate FROM documents),
s AS (SELECT *, CASE WHEN w = 0 THEN 'empty' WHEN w < 50 THEN 'thin' END AS short FROM p)
SELECT coalesce(nullif(concat_ws('+', short, CASE WHEN (short IS NOT NULL OR w < 100) AND size < 1024 THEN 'tiny_html' END), ''), CASE WHEN status IN (401, 403) OR (w < 100 AND gate) THEN 'auth_gate' WHEN w < 0.5 * prev THEN 'content_regression' WHEN q < 0.4 THEN 'extraction_incomplete' END, 'ok') AS issue, count(*) AS n FROM s GROUP BY 1""")
def quality_check(spark, sf_dir):
    k = F.col("doc_id")
    issue = quality.page_issue(text.word_count("text"), F.col("n_chars"), F.when(k % 17 == 0, 403).otherwise(200), F.when(k % 3 == 0, F.col("n_chars") / 2), F.when(k % 4 == 0, "Please Sign In to go on").otherwise("text"), F.when(k % 5 == 0, 0.3).otherwise(0.9))
    return table(spark, sf_dir, "documents").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT 'pages_without_title' AS name, CASE WHEN count(*) >= 1 THEN 'warn' ELSE 'pass' END AS status, count(*) AS n FROM pages WHERE NOT regexp_matches(html, '(?i)<h1') UNION ALL
SELECT 'orders_without_customer', CASE WHEN count(*) >= 5 THEN 'fail' WHEN count(*) >= 1 THEN 'warn' ELSE 'pass' END, count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'error_events', CASE WHEN count(*) >= 1 THEN 'warn' ELSE 'pass' END, count(*) FROM events WHERE event_type = 'error')
SELECT arg_max(status, list_position(['skip', 'pass', 'warn', 'fail', 'error'], status)) AS status, count(*) AS n_checks, sum(n)::BIGINT AS n_issues FROM c""")
def audit_rollup(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return quality.audit([
        quality.check("pages_without_title", table(spark, sf_dir, "pages").filter(markup.tag_count("html", "h1") == 0)),
        quality.check("orders_without_customer", orders.join(customer, orders.o_custkey == customer.c_custkey, "left_anti"), fail=5),
        quality.check("error_events", table(spark, sf_dir, "events").filter("event_type = 'error'")),
    ])
