"""Structured Streaming over crawl batches and events: the incremental form of the store's upserts.

The store this engine models has no event-time policy; watermarks and windows are an addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup, text, urls
from ..sources import commits

PAGES = T.StructType([T.StructField("run", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("ts", T.TimestampType())])


def page_batches(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def cleaned(pages: DataFrame) -> DataFrame:
    """Accepted URLs in canonical form with their content's hash."""
    ok = pages.filter(urls.rejection("url").isNull())
    body = text.normalized_markdown(F.regexp_replace("html", "<[^>]+>", " "))
    return ok.select(urls.canonical("url").alias("url"), F.sha2(body, 256).alias("digest"), markup.title("html").alias("title"), "run", "ts")


def deduplicated(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A page with the same content within the watermark comes once."""
    return pages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url", "digest"])


STATE, CHANGES = "digest string, run long", "url string, digest string, prev_digest string, run long, action string"


def last_of_batch(pages: DataFrame) -> DataFrame:
    """(url, digest, run): of each Arrow batch the last row of each URL by run, so that a frequent URL moves as a few rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(["run", "digest"], kind="stable").groupby("url", as_index=False, dropna=False).last()[["url", "digest", "run"]]

    return pages.select("url", "digest", "run").mapInPandas(run, "url string, digest string, run long")


def changes(pages: DataFrame) -> DataFrame:
    """(url, digest, prev_digest, run, action) for each URL of a micro-batch: new, updated or unchanged against the URL's last row before.

    What is known of a URL is its keyed state, so a micro-batch costs what it holds, however large the store has grown; as
    in lineage.page_upsert the last row by run holds. Use a state store on disk for many URLs
    (spark.sql.streaming.stateStore.providerClass).
    """

    def put(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = max((r for part in rows for r in zip(part["run"].tolist(), part["digest"].tolist(), strict=True)), key=lambda r: (r[0], r[1] or ""))
        old = state.get if state.exists else None
        state.update((last[1], last[0]))
        action = "new" if old is None else "updated" if old[0] != last[1] else "unchanged"
        yield pd.DataFrame({"url": [key[0]], "digest": [last[1]], "prev_digest": [old[0] if old else None], "run": [last[0]], "action": [action]})

    return last_of_batch(pages).groupBy("url").applyInPandasWithState(put, CHANGES, STATE, "append", "NoTimeout")


def change_sink(store: str, writer: str = "pages", compact_after: int = 64):
    """For foreachBatch: publishes a micro-batch as a part of the store's page_changes under its number, so that one that comes again changes nothing; small parts are put together now and then."""

    def put(batch: DataFrame, batch_id: int) -> None:
        done = commits.append(batch.select(*(c.split()[0] for c in CHANGES.split(", "))), store, "page_changes", batch=(writer, batch_id))
        if len(done.parts("page_changes")) >= compact_after:
            commits.compact(batch.sparkSession, store, "page_changes")

    return put


def run_upserts(pages: DataFrame, store: str, checkpoint: str, writer: str = "pages"):
    """Starts the query; it takes what is there and ends. pages: url, digest, run."""
    return changes(pages).writeStream.foreachBatch(change_sink(store, writer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_pages(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The last change of each URL in a version of the store, by default the newest."""
    snapshot = commits.latest(spark, store) if version is None else commits.at(spark, store, version)
    rows = snapshot.read(spark, "page_changes", CHANGES)
    return rows.groupBy("url").agg(F.max(F.struct("run", "digest", "prev_digest", "action")).alias("r")).select("url", "r.digest", "r.prev_digest", "r.run", "r.action")


def event_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """(start, end, event_type, n) in tumbling windows, or sliding ones; later events than the delay are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): a user's events with less than the gap between them."""
    counts = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
