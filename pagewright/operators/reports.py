"""Review queues, discovery checks and reports. A report is text made on the driver from aggregates of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls


def review_list(queue: DataFrame, status: str = "open", limit: int = 50) -> DataFrame:
    """A top-k report: newest first."""
    return queue.filter(F.col("status") == status).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def review_resolve(queue: DataFrame, ids: list[int], status: str = "resolved") -> DataFrame:
    return queue.withColumn("status", F.when(F.col("id").isin(ids), status).otherwise(F.col("status")))


def auto_resolve(queue: DataFrame, as_of, kinds: tuple[str, ...] = ("source_changed", "stale_citation"), days: int = 7) -> DataFrame:
    """Open items of these kinds that are older than the days are resolved."""
    old = (F.col("status") == "open") & F.col("kind").isin(*kinds) & (F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    return queue.withColumn("status", F.when(old, "resolved").otherwise(F.col("status")))


def discovery_warnings(found: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: warnings. found: url, method. All methods empty while the store has pages; a method under 20 URLs and another over ten times it; over half of fewer than 50 URLs found by one method alone."""
    by_url = found.groupBy("url").agg(F.countDistinct("method").alias("n_methods"))
    urls = by_url.agg(F.count("*").alias("total"), F.count_if(F.col("n_methods") == 1).alias("single"))
    methods = found.groupBy("method").agg(F.countDistinct("url").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("methods"))
    row = urls.crossJoin(methods).crossJoin(stored.agg(F.count("*").alias("stored")))  # three rows of one
    return row.select(F.array_compact(F.array(
        F.when((F.col("total") == 0) & (F.col("stored") > 0), "all_methods_failed"),
        F.when((F.col("methods") >= 2) & (F.col("low") < 20) & (F.col("high") > 10 * F.col("low")), "method_divergence"),
        F.when((F.col("total") > 0) & (F.col("total") < 50) & (F.col("single") > 0.5 * F.col("total")), "low_cross_validation"),
    )).alias("warnings"))


def discovered_sources(evidence: DataFrame, most: int = 5) -> DataFrame:
    """(url, kinds, evidences): for each URL the kinds, sorted, and the first evidences. evidence: url, kind, evidence."""
    return evidence.groupBy("url").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.slice(F.array_sort(F.collect_set("evidence")), 1, most).alias("evidences"))


def stale_sitemap_entries(entries: DataFrame, as_of, days: int = 365) -> DataFrame:
    """One row: total, stale. entries: lastmod; dates that cannot be read are not stale."""
    return entries.agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.datediff(as_of, F.try_to_timestamp("lastmod")) > days, F.lit(False))).alias("stale"))


def markdown_table(df: DataFrame, title: str, limit: int = 1_000) -> str:
    """A report's table: the first rows of an aggregate in the order it has."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def envelope(result: DataFrame, version: str = "v1") -> DataFrame:
    """One JSON object for each row: ok, schema_version, result."""
    return result.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(version).alias("schema_version"), F.struct(*(F.col(f"`{c}`") for c in result.columns)).alias("result"))).alias("json"))


def changelogs(entries: DataFrame, source: str | None = None, section: str | None = None, since: str | None = None, undated: bool = True) -> DataFrame:
    """Entries of a source and section from a date on, with the first 300 characters; undated ones stay unless told otherwise. entries: source, section, entry_date, entry_text, source_url."""
    rows = entries
    for name, value in (("source", source), ("section", section)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if since is not None:
        new = F.col("entry_date") >= since
        rows = rows.filter(F.col("entry_date").isNull() | new if undated else new)
    return rows.withColumn("excerpt", F.substring("entry_text", 1, 300))


def changelog_page(entries: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the list, newest first and undated last, each row with the number of all (a top-k report)."""
    total = entries.agg(F.count("*").alias("total"))
    page = entries.orderBy(F.col("entry_date").desc_nulls_last(), "source_url", "excerpt").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def classified_changelogs(entries: DataFrame, severity: str | None = None) -> DataFrame:
    """entries with classes, severity and affected_paths by their first 3000 characters; those of one severity where it is given."""
    head = F.substring("entry_text", 1, 3_000)
    rows = entries.withColumns({"classes": text.impact_classes(head), "severity": text.max_severity(head), "affected_paths": text.affected_paths(head)})
    return rows if severity is None else rows.filter(F.col("severity") == severity)


def markup_counters(pages: DataFrame, markdown: str = "md") -> DataFrame:
    """One row: pages, and for [code] marks, fences, lines with bars, table tags, links and headings how often they occur and on how many pages."""
    c = F.col(markdown)
    marks = {
        "code_tags": F.regexp_count(c, F.lit(r"\[code\]")), "fences": F.regexp_count(c, F.lit("```")), "table_lines": F.size(F.filter(F.split(c, "\n"), lambda s: s.contains("|") & (F.length(F.trim(s)) > 2))),
        "html_tables": F.regexp_count(c, F.lit(r"(?i)<table\b")), "links": F.regexp_count(c, F.lit(r"\[[^\]]+\]\([^)]+\)")), "headings": F.size(F.filter(F.split(c, "\n"), lambda s: F.ltrim(s).startswith("#"))),
    }
    rows = pages.select(*(m.cast("bigint").alias(n) for n, m in marks.items()))
    sums = [x for n in marks for x in (F.sum(n).alias(n), F.count_if(F.col(n) > 0).alias(f"pages_with_{n}"))]
    return rows.agg(F.count("*").alias("pages"), *sums)


def crawl_metrics(versions: DataFrame, pages: DataFrame, runs: list[int]) -> DataFrame:
    """(domain, http_status, n, raw_bytes) of the runs' page versions; 429s by domain are rows of it. versions: page_id, run, http_status, raw_bytes; pages: page_id, domain."""
    rows = versions.filter(F.col("run").isin(runs)).join(pages.select("page_id", "domain"), "page_id")
    return rows.groupBy("domain", F.coalesce("http_status", F.lit(0)).alias("http_status")).agg(F.count("*").alias("n"), F.sum(F.coalesce("raw_bytes", F.lit(0))).alias("raw_bytes"))


#: Counters of a section's sync.
SYNC = ("inventory_urls", "added", "removed", "fetched", "stored", "unchanged", "updated", "new", "skipped", "errors", "bytes", "seconds")


def sync_totals(sections: DataFrame) -> DataFrame:
    """One row: sections, sections with an error, and the sum of each counter. sections: section, error and those of SYNC that it has."""
    have = [c for c in SYNC if c in sections.columns]
    return sections.agg(F.count("*").alias("sections"), F.count_if(F.col("error").isNotNull()).alias("failed"), *(F.sum(c).alias(c) for c in have))


def run_samples(versions: DataFrame, runs: tuple[int, int], n: int = 3, key: str = "key", run: str = "run", digest: str = "digest") -> DataFrame:
    """(change, samples): the first n keys, by key, that are new, updated or stale in the second run (stale: of the first alone). A report."""
    at = lambda r: F.max(F.when(F.col(run) == r, F.col(digest)))
    both = versions.filter(F.col(run).isin(*runs)).groupBy(key).agg(at(runs[0]).alias("a"), at(runs[1]).alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "stale").when(F.col("a") != F.col("b"), "updated")
    from pyspark.sql import Window

    rows = both.select(F.col(key).alias("key"), change.alias("change")).filter("change IS NOT NULL")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("change").orderBy("key"))).filter(F.col("r") <= n)  # n rows of each task go on
    return first.groupBy("change").agg(F.array_sort(F.collect_list("key")).alias("samples"))


def sync_report(totals: DataFrame, sections: DataFrame) -> str:
    return "# Sync\n\n" + markdown_table(totals, "Totals") + "\n" + markdown_table(sections.orderBy("section"), "Sections")


def store_markdown(by_domain: DataFrame, statuses: DataFrame, stale: DataFrame) -> str:
    return "# Store\n\n" + "\n".join(markdown_table(df, name) for name, df in (("Pages by domain", by_domain), ("Entries by status", statuses), ("Stale pages", stale)))


def coverage_markdown(coverage: DataFrame, gaps: DataFrame) -> str:
    return "# Coverage\n\n" + markdown_table(coverage, "Fields") + "\n" + markdown_table(gaps, "Gaps")


def rejected_urls(entries: DataFrame, url: str = "url") -> DataFrame:
    """(reason, n): why entries are no documents."""
    return entries.select(urls.rejection(url).alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
