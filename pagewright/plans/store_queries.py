"""Queries over stores: reports, snapshots, set comparisons. The test tables stand for inventories, runs and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import coverage, reports, store
from .registry import query, table


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE date_diff('microsecond', o_orderdate, TIMESTAMP '2000-01-01 12:00:00') / 86400000000.0 > 500.0")
def stale_pages(spark, sf_dir):
    as_of = F.lit("2000-01-01 12:00:00").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.filter(store.stale(F.col("o_orderdate"), as_of, 500.0))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN json_extract(props, '$.k') IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_k, sum(CASE WHEN json_extract(props, '$.z') IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_z FROM events GROUP BY 1")
def missing_json_field(spark, sf_dir):
    missing = lambda path: F.count_if(F.get_json_object("props", path).isNull())
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), missing("$.k").alias("missing_k"), missing("$.z").alias("missing_z"))


@query("SELECT substr(url, 1, instr(substr(url, 9), '/') + 8) AS origin, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, origin LIMIT 20")
def domain_breakdown(spark, sf_dir):
    """A top-k report."""
    counts = store.counts_by(table(spark, sf_dir, "pages").select(urls.origin("url").alias("origin")), "origin")
    return store.top_k(counts, 20, F.col("n").desc(), "origin")


@query("""
WITH v AS (SELECT user_id AS key, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS run, max(event_type) AS digest FROM events GROUP BY 1, 2),
p AS (SELECT key, max(CASE WHEN run = 1 THEN digest END) AS a, max(CASE WHEN run = 2 THEN digest END) AS b FROM v GROUP BY 1)
SELECT count(*) FILTER (a IS NULL AND b IS NOT NULL) AS "new", count(*) FILTER (a <> b) AS updated, count(*) FILTER (a = b) AS unchanged, count(*) FILTER (b IS NULL) AS stale FROM p""")
def version_diff_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(2).alias("run"), F.col("event_type").alias("digest"))
    return store.version_diff(e, (1, 2))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return store.counts_by(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status")


@query("SELECT l_suppkey AS source, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, source LIMIT 15")
def top_sources(spark, sf_dir):
    """A top-k report."""
    return store.top_k(store.counts_by(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source")), "source"), 15, F.col("n").desc(), "source")


_OLD, _NEW = "o_orderkey % 10 <> 0", "o_orderkey % 7 <> 0"


@query(f"""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE {_OLD}), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE {_NEW})
SELECT (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS added, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS removed, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS kept""")
def inventory_diff(spark, sf_dir):
    """Two snapshots of a key set; the remainders only make the snapshots."""
    orders = table(spark, sf_dir, "orders")
    return store.inventory_diff(orders.filter(_OLD).select(F.col("o_custkey").alias("k")), orders.filter(_NEW).select(F.col("o_custkey").alias("k")))


@query("""
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders), f AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, count(*) FILTER (x = y) AS both, round(100.0 * count(*) FILTER (x = y) / count(y), 2)::DOUBLE AS coverage_pct FROM f""")
def url_set_overlap(spark, sf_dir):
    return store.set_overlap(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("""
WITH l AS (SELECT o_custkey AS source, o_orderpriority AS section, max((o_orderdate, o_orderkey)) AS m FROM orders GROUP BY 1, 2)
SELECT source, section, o_orderkey AS inventory_id, o_orderstatus AS status FROM l JOIN orders ON o_custkey = source AND o_orderpriority = section AND (o_orderdate, o_orderkey) = m""")
def latest_inventory_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("section"), "o_orderdate", F.col("o_orderkey").alias("inventory_id"), F.col("o_orderstatus").alias("status"))
    return store.latest_per(o, ["source", "section"], ["o_orderdate", "inventory_id"]).drop("o_orderdate")


@query("""
WITH u AS (SELECT o_custkey AS url, 'sitemap' AS method, 0 AS ord FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'link_follow', 1 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey, 'nav', 2 FROM customer)
SELECT url, list_sort(list(DISTINCT method)) AS methods, arg_min(method, ord) AS first_seen_via FROM u GROUP BY 1""")
def provenance_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = lambda df, method, n: df.withColumns({"method": F.lit(method), "ord": F.lit(n)})
    found = by(o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("url")), "sitemap", 0)
    found = found.unionByName(by(o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("url")), "link_follow", 1))
    found = found.unionByName(by(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url")), "nav", 2))
    return store.with_provenance(found, "url", "method", "ord")


@query("""
WITH c AS (SELECT l_returnflag AS scope, l_partkey AS url, l_linestatus AS owner, l_linenumber % 3 AS priority, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, url ORDER BY priority, seq, owner) AS n FROM c)
SELECT scope, url, owner, priority FROM r WHERE n = 1""")
def scope_ownership(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("scope"), F.col("l_partkey").alias("url"), F.col("l_linestatus").alias("owner"), (F.col("l_linenumber") % 3).alias("priority"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return store.scope_ownership(c)


@query("""
WITH c AS (SELECT l_returnflag AS scope, l_partkey AS url, l_linestatus AS owner, l_linenumber % 3 AS priority, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, url ORDER BY priority, seq, owner) AS n FROM c), h AS (SELECT * FROM r WHERE n = 1)
SELECT c.owner, count(*) AS n FROM c JOIN h USING (scope, url) WHERE h.owner <> c.owner AND h.priority <= c.priority GROUP BY 1""")
def scope_skips(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("scope"), F.col("l_partkey").alias("url"), F.col("l_linestatus").alias("owner"), (F.col("l_linenumber") % 3).alias("priority"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return store.counts_by(store.scope_skips(c.drop("seq"), store.scope_ownership(c)), "owner")


@query("""
WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), i AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT i.* FROM i ANTI JOIN e USING (user_id, event_type)""")
def insert_or_ignore(spark, sf_dir):
    """Odd events come upon even ones; the remainders only make the two batches."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return store.insert_or_ignore(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"])


@query("""
WITH d AS (SELECT DISTINCT o_orderpriority AS section, o_custkey AS url FROM orders WHERE o_orderstatus <> 'P'), s AS (SELECT DISTINCT o_orderpriority AS section, o_custkey AS url FROM orders WHERE o_orderstatus <> 'F')
SELECT section, count(d.url) AS n_discovered, count(s.url) AS n_stored, count(CASE WHEN d.url IS NOT NULL AND s.url IS NOT NULL THEN 1 END) AS n_both, CASE WHEN count(d.url) = 0 THEN 100.0 ELSE round(100.0 * count(CASE WHEN d.url IS NOT NULL AND s.url IS NOT NULL THEN 1 END) / count(d.url), 2) END::DOUBLE AS pct
FROM d FULL JOIN s USING (section, url) GROUP BY 1""")
def coverage_pct(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("section"), F.col("o_custkey").alias("url"), "o_orderstatus")
    return store.coverage_by_section(o.filter("o_orderstatus <> 'P'").drop("o_orderstatus"), o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"))


@query("""
WITH f AS (SELECT CASE WHEN event_id % 13 = 0 THEN NULL ELSE 200 + (event_id % 4) * 100 + event_id % 5 END AS status FROM events)
SELECT CASE WHEN status IS NULL OR status = 0 THEN 'network_error' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN status BETWEEN 400 AND 499 THEN 'client_error' ELSE 'other' END AS bucket, count(*) AS n FROM f GROUP BY 1""")
def http_buckets(spark, sf_dir):
    status = F.when(F.col("event_id") % 13 != 0, 200 + (F.col("event_id") % 4) * 100 + F.col("event_id") % 5)
    return store.counts_by(table(spark, sf_dir, "events").select(store.http_bucket(status).alias("bucket")), "bucket")


@query("SELECT '/' || split_part(p, '/', 2) || '/' || split_part(p, '/', 3) AS prefix, count(*) AS n FROM (SELECT regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS p FROM pages) GROUP BY 1 ORDER BY n DESC, prefix LIMIT 5")
def path_prefix_topk(spark, sf_dir):
    """A top-k report."""
    path = F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "")
    prefix = F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)), F.lit("/"), F.split_part(path, F.lit("/"), F.lit(3)))
    return store.top_k(store.counts_by(table(spark, sf_dir, "pages").select(prefix.alias("prefix")), "prefix"), 5, F.col("n").desc(), "prefix")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS entry_date FROM orders ORDER BY entry_date DESC NULLS LAST, o_orderkey DESC LIMIT 50")
def latest_entries(spark, sf_dir):
    """A top-k report, entries without a date last."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("entry_date"))
    return store.top_k(o, 50, F.col("entry_date").desc_nulls_last(), F.col("o_orderkey").desc())


@query("SELECT o_custkey AS source, o_orderpriority AS section, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1, 2")
def store_report_inventories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("section"), "o_orderdate")
    return store.counts_by(o, "source", "section", latest=F.max("o_orderdate"))


@query("SELECT source, lang, count(*) AS n_pages, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')))::BIGINT AS n_words FROM documents GROUP BY 1, 2")
def store_report_pages(spark, sf_dir):
    from ..functions import text

    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_pages"), F.sum(text.word_count("text")).alias("n_words"))


@query("SELECT l_suppkey AS source, l_returnflag AS section, l_linestatus AS protocol, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def store_report_records(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("protocol"))  # noqa: E741
    return store.counts_by(l, "source", "section", "protocol")


_STATUS = "CASE WHEN l_orderkey % {n} = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'documented' ELSE 'unknown' END"


@query(f"""
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS record_id, l_returnflag AS source, l_linestatus AS section, {_STATUS.format(n=5)} AS a, {_STATUS.format(n=7)} AS b FROM lineitem),
u AS (SELECT record_id, source, section, 'description' AS field, coalesce(a, 'missing') AS status FROM r UNION ALL SELECT record_id, source, section, 'rate_limit', coalesce(b, 'missing') FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY field, status ORDER BY source, section, record_id) AS i FROM u)
SELECT field, status, count(*) AS n, list(record_id ORDER BY i) FILTER (i <= 5) AS samples FROM k GROUP BY 1, 2""")
def field_coverage(spark, sf_dir):
    return coverage.field_coverage(_records(spark, sf_dir), ("description", "rate_limit"))


@query(f"""
WITH r AS (SELECT l_returnflag AS source, l_linestatus AS section, {_STATUS.format(n=5)} AS a, {_STATUS.format(n=7)} AS b FROM lineitem),
u AS (SELECT source, section, 'description' AS field, coalesce(a, 'missing') AS status FROM r UNION ALL SELECT source, section, 'rate_limit', coalesce(b, 'missing') FROM r),
c AS (SELECT source, section, field, status, count(*) AS n FROM u GROUP BY ALL)
SELECT source, section, field, list(status ORDER BY status) AS statuses, list(n ORDER BY status) AS counts FROM c GROUP BY 1, 2, 3""")
def coverage_gaps(spark, sf_dir):
    gaps = coverage.coverage_gaps(_records(spark, sf_dir), ("description", "rate_limit"), ("source", "section"))
    return gaps.select("source", "section", "field", F.map_keys("status_counts").alias("statuses"), F.map_values("status_counts").alias("counts"))


def _records(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    status = lambda n: F.when(F.col("l_orderkey") % n == 0, F.lit(None)).when(F.col("l_linenumber") % 2 == 0, "documented").otherwise("unknown")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("section"),
                    F.create_map(F.lit("description"), status(5), F.lit("rate_limit"), status(7)).alias("field_status"))


@query("SELECT count(*) FILTER (user_id % 3 = 0) AS fetched, count(*) FILTER (user_id % 3 = 1) AS skipped, count(*) FILTER (event_type = 'error') AS errors, sum(value)::DOUBLE AS total FROM events")
def sync_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("user_id") % 3 == 0).alias("fetched"), F.count_if(F.col("user_id") % 3 == 1).alias("skipped"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total"))


@query("SELECT count(*) AS n, regr FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-06-17' - INTERVAL 7 DAYS AND o_orderstatus IN ('F', 'P') THEN 'resolved' ELSE 'open' END AS regr FROM orders) GROUP BY 2")
def review_auto_resolve(spark, sf_dir):
    """Old items of certain kinds are resolved."""
    queue = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.lit("open").alias("status"), F.col("o_orderdate").alias("created_at"))
    done = reports.auto_resolve(queue, F.lit("1999-06-17").cast("timestamp_ntz"), ("F", "P"))
    return done.groupBy(F.col("status").alias("regr")).agg(F.count("*").alias("n"))


@query("SELECT sha256(string_agg(u, '\\n' ORDER BY u)) AS inventory_hash FROM (SELECT DISTINCT 'https://x.example/' || o_orderpriority AS u FROM orders)")
def inventory_hash(spark, sf_dir):
    return store.inventory_hash(table(spark, sf_dir, "orders").select(F.concat(F.lit("https://x.example/"), "o_orderpriority").alias("url")).distinct())
