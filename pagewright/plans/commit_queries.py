"""Stores with a commit log: writers at once, streamed changes, compaction."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..sources import commits, places
from ..streaming import crawl
from .registry import query, table

_ROWS, _TOTALS = "event_id long, event_type string, value double", "event_type string, n long, writers long"


@query("SELECT event_type, count(*) AS n, 4::BIGINT AS writers, count(*) AS stored FROM events GROUP BY 1")
def concurrent_commits(spark, sf_dir):
    """Four writers at once, each a quarter of the events: a part of the rows and new totals, published together or not at all."""
    root = places.fresh(spark, "store")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("double").alias("value"))

    def write(k: int) -> None:
        own = events.filter(F.col("event_id") % 4 == k)

        def change(s: commits.Snapshot) -> commits.Change:
            rows = own.groupBy("event_type").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("writers"))
            totals = s.read(spark, "totals", _TOTALS).unionByName(rows).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("writers").alias("writers"))
            return commits.Change(
                {"rows": [commits.stage(own, root, "rows")], "totals": [commits.stage(totals.coalesce(1), root, "totals")]}, {"totals": [p["path"] for p in s.parts("totals")]}, {"totals"}
            )

        commits.commit(spark, root, change)

    with ThreadPoolExecutor(4) as writers:
        list(writers.map(write, range(4)))
    last = commits.latest(spark, root)
    stored = last.read(spark, "rows", _ROWS).groupBy("event_type").agg(F.count("*").alias("stored"))
    return last.read(spark, "totals", _TOTALS).join(stored, "event_type")


@query("""
WITH b AS (SELECT user_id::VARCHAR AS url, event_type AS digest, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS run FROM events),
l AS (SELECT url, run, max(digest) AS digest FROM b GROUP BY ALL), p AS (SELECT *, lag(digest) OVER (PARTITION BY url ORDER BY run) AS prev_digest, row_number() OVER (PARTITION BY url ORDER BY run DESC) AS k FROM l)
SELECT url, digest, prev_digest, run, CASE WHEN prev_digest IS NULL THEN 'new' WHEN prev_digest <> digest THEN 'updated' ELSE 'unchanged' END AS action FROM p WHERE k = 1""")
def streamed_upserts(spark, sf_dir):
    """Three micro-batches of page versions (here a user's events) into a store by keyed state; the last change of each page."""
    inbox, store, checkpoint = (places.fresh(spark, f"stream-{n}") for n in ("in", "store", "checkpoint"))
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    rows = events.select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("digest"), F.expr(f"event_id * 3 DIV {last + 1}").alias("run"))
    for run in range(3):
        rows.filter(F.col("run") == run).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    crawl.run_upserts(stream, store, checkpoint).awaitTermination()
    return crawl.current_pages(spark, store)


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, 1 AS files FROM events GROUP BY 1")
def compacted_parts(spark, sf_dir):
    """Three parts of many small files; afterwards the same rows in one file (as long as they fit into 128 MB)."""
    root = places.fresh(spark, "store")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("double").alias("value"))
    for k in range(3):
        commits.append(events.filter(F.col("event_id") % 3 == k).repartition(4), root, "rows")
    last = commits.compact(spark, root, "rows")
    files = sum(p["files"] for p in last.parts("rows"))
    return last.read(spark, "rows", _ROWS).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.lit(files).alias("files"))
