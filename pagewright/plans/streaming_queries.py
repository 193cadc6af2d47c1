"""Event windows and the adaptive delay, run over a table at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching, inventory
from ..streaming import crawl
from .registry import query, table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return crawl.event_counts(e).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return crawl.sessions(e).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("""
WITH RECURSIVE l AS (SELECT (user_id % 50)::VARCHAR AS domain, event_id AS seq, CASE event_type WHEN 'error' THEN 2.0 ELSE 0.9 END::DOUBLE AS m, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
r AS (SELECT domain, seq, i, least(greatest(1.0 * m, 1.0), 60.0) AS delay FROM l WHERE i = 1 UNION ALL SELECT l.domain, l.seq, l.i, least(greatest(r.delay * l.m, 1.0), 60.0) FROM r JOIN l ON l.domain = r.domain AND l.i = r.i + 1)
SELECT domain, seq, round(delay, 6) AS delay FROM r""")
def adaptive_delay(spark, sf_dir):
    """A fold over the responses of a domain in their order."""
    e = table(spark, sf_dir, "events")
    log = e.select((F.col("user_id") % 50).cast("string").alias("domain"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"))
    return inventory.adaptive_delay(log).withColumn("delay", F.round("delay", 6))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 500 AS src, l_suppkey * 7 % 500 AS dst FROM lineitem), r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""")
def frontier_closure(spark, sf_dir):
    """Pages reachable from page 0 over links, here an order's part to the next."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    links = l.select((F.col("l_partkey") % 500).alias("src"), (F.col("l_suppkey") * 7 % 500).alias("dst")).distinct()
    return inventory.reachable(links, spark.createDataFrame([(0,)], "node bigint"), 3)


def _frontier_sql(max_pages: int, max_queue: int, rounds: int) -> str:
    """The same rounds written out one after the other."""
    steps = [
        "l AS (SELECT DISTINCT 's' || l_linenumber % 3 AS section, 'p' || l_partkey % 300 AS src, 'p' || (l_suppkey * 7 + l_linenumber * 11) % 300 AS dst FROM lineitem)",
        "q0 AS (SELECT DISTINCT section, 'p' || x AS url, 0 AS round FROM l, (SELECT unnest([0, 7, 150]) AS x))",
    ]
    for r in range(1, rounds + 1):
        known = " UNION ALL ".join(f"SELECT section, url FROM q{k}" for k in range(r))
        done = " UNION ALL ".join(f"SELECT section, visit FROM v{k}" for k in range(1, r)) or "SELECT NULL AS section, 0 AS visit WHERE false"
        steps += [
            f"v{r} AS (SELECT section, url, round, CASE WHEN k + coalesce(n, 0) <= {max_pages} THEN k + coalesce(n, 0) END::INT AS visit FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY url) AS k FROM q{r - 1}) LEFT JOIN (SELECT section, count(visit) AS n FROM ({done}) GROUP BY 1) USING (section))",
            f"k{r} AS ({known})",
            f"q{r} AS (SELECT section, url, {r} AS round FROM (SELECT section, url, row_number() OVER (PARTITION BY section ORDER BY url) AS n FROM (SELECT DISTINCT v.section, dst AS url FROM v{r} v JOIN l ON l.section = v.section AND l.src = v.url WHERE visit IS NOT NULL) f WHERE NOT EXISTS (SELECT 1 FROM k{r} k WHERE k.section = f.section AND k.url = f.url)) JOIN (SELECT section, count(*) AS queued FROM k{r} GROUP BY 1) USING (section) WHERE n + queued <= {max_queue})",
        ]
    all_visits = " UNION ALL ".join(f"SELECT section, url, round, visit FROM v{r}" for r in range(1, rounds + 1))
    return f"WITH {', '.join(steps)} {all_visits} UNION ALL SELECT section, url, round, NULL FROM q{rounds}"


@query(_frontier_sql(40, 120, 5))
def ordered_frontier(spark, sf_dir):
    """A crawl over links in the order of URLs, with 40 visits and 120 queued pages a section."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    page = lambda c: F.concat(F.lit("p"), (c % 300).cast("string"))
    links = l.select(F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string")).alias("section"), page(F.col("l_partkey")).alias("src"), page(F.col("l_suppkey") * 7 + F.col("l_linenumber") * 11).alias("dst")).distinct()
    seeds = links.select("section").distinct().select("section", F.explode(F.array(F.lit("p0"), F.lit("p7"), F.lit("p150"))).alias("url"))
    return inventory.ordered_frontier(links, seeds, 40, 120, 5)


@query("SELECT count(*) AS n_rows, sum(strlen(text) + 1)::BIGINT AS size, 0 AS over, true AS full_enough FROM documents")
def length_batches(spark, sf_dir):
    """Documents in batches of 64 KB by length: none over its budget unless it is one document, and of the neighbours in a partition no two that would fit into one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    batches = batching.length_batches(d, F.col("n") + 1, 65_536).groupBy("batch").agg(F.count("*").alias("n_rows"), F.sum("batch_size").alias("size"), F.min("batch_size").alias("least"))
    after = batches.select((F.col("batch") - 1).alias("batch"), F.col("least").alias("next_least"))
    both = batches.join(after, "batch", "left")
    over = ((F.col("size") > 65_536) & (F.col("n_rows") > 1)).cast("int")
    full = F.col("next_least").isNull() | (F.col("size") + F.col("next_least") > 65_536)
    return both.agg(F.sum("n_rows").alias("n_rows"), F.sum("size").alias("size"), F.sum(over).cast("int").alias("over"), F.min(full).alias("full_enough"))
