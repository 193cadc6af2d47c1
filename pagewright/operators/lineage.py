"""Citations, invalidation, upserts, incremental diffs. Tables are snapshots: an upsert makes the new snapshot, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..functions import pages as page_functions

MAX_EXCERPT = 600


def missing_sources(citations: DataFrame, pages: DataFrame, key: str = "doc_url") -> DataFrame:
    return citations.join(pages.select(key), key, "left_anti")


def stale_citations(citations: DataFrame, pages: DataFrame, key: str = "doc_url") -> DataFrame:
    """Citations whose page has another hash now. Both: key, doc_hash."""
    now = pages.select(key, F.col("doc_hash").alias("current_hash"))
    return citations.join(now, key).filter(F.col("doc_hash").isNotNull() & (F.col("doc_hash") != F.col("current_hash")))


def orphans(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that one side alone has."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def page_upsert(current: DataFrame, incoming: DataFrame, key: str = "url") -> DataFrame:
    """The new snapshot (key, digest, prev_digest, run, action): new, updated and unchanged come from incoming, of which the last by run holds; others are kept. Both: key, digest, run."""
    last = incoming.groupBy(key).agg(F.max(F.struct("run", "digest")).alias("i"))
    old = current.select(key, F.col("digest").alias("old"), F.col("run").alias("old_run"))
    both = old.join(last, key, "full")
    action = F.when(F.col("i").isNull(), "kept").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("i.digest"), "updated").otherwise("unchanged")
    return both.select(key, F.coalesce("i.digest", "old").alias("digest"), F.when(F.col("i").isNotNull(), F.col("old")).alias("prev_digest"), F.coalesce("i.run", "old_run").alias("run"), action.alias("action"))


def invalidated(upserted: DataFrame, citations: DataFrame, key: str = "url") -> DataFrame:
    """(record_id, field_name) that cite the old hash of a page that has changed, each once. citations: key, doc_hash, record_id, field_name."""
    changed = upserted.filter("action = 'updated'").select(key, F.col("prev_digest").alias("doc_hash"))
    return citations.join(changed, [key, "doc_hash"], "left_semi").select("record_id", "field_name").distinct()


def incremental_diff(indexed: DataFrame, pages: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): add, replace, remove; what is equal is left out."""
    a = indexed.groupBy(key).agg(F.max(digest).alias("a"))
    both = a.join(pages.select(key, F.col(digest).alias("b")), key, "full")
    action = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").when(F.col("a") != F.col("b"), "replace")
    return both.select(key, action.alias("action")).filter("action IS NOT NULL")


def citation_error(page_hash: Column, page_text: Column) -> Column:
    """The first rule that a citation breaks, null if none. Offsets count characters from 0."""
    start, end = F.col("excerpt_start"), F.col("excerpt_end")
    return (
        F.when(end <= start, "EBADRANGE").when(F.length("excerpt") > MAX_EXCERPT, "ETOOLONG").when(page_hash.isNull(), "ENOPAGE")
        .when(F.col("content_hash").isNotNull() & (F.col("content_hash") != page_hash), "EHASH").when(page_text.isNull() | (page_text == ""), "ENOTEXT")
        .when(end > F.length(page_text), "EBOUNDS").when(F.substring(page_text, start + 1, end - start) != F.col("excerpt"), "EEXCERPT")
    )


def verify_citations(citations: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """citations with error. citations: key, content_hash, excerpt_start, excerpt_end, excerpt; pages: key, page_hash, page_text."""
    joined = citations.join(pages.select(key, "page_hash", "page_text"), key, "left")
    return joined.withColumn("error", citation_error(F.col("page_hash"), F.col("page_text"))).drop("page_hash", "page_text")


def field_rules(records: DataFrame, cited: DataFrame) -> DataFrame:
    """(record_id, field_name, error): documented fields need a citation and a value. records: record_id, field_name, status, value; cited: record_id, field_name."""
    has = cited.select("record_id", "field_name").distinct().withColumn("__c", F.lit(True))
    rows = records.filter("status = 'documented'").join(has, ["record_id", "field_name"], "left")
    error = F.when(F.col("__c").isNull(), "ENOCITATION").when(F.col("value").isNull() | (F.trim("value") == ""), "EEMPTY")
    return rows.select("record_id", "field_name", error.alias("error")).filter("error IS NOT NULL")


def excerpt(c: Column, needle: str, before: int = 200, size: int = 550) -> Column:
    """A struct of text, start and end around the first place of the needle; null if it is not there."""
    at = F.instr(F.lower(c), needle.lower())
    start = F.greatest(at - 1 - before, F.lit(0))
    return F.when(at > 0, F.struct(F.substring(c, start + 1, F.lit(size)).alias("excerpt"), start.alias("excerpt_start"), F.least(start + size, F.length(c)).alias("excerpt_end")))


def open_new_items(found: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """Findings without an identical open item."""
    return found.join(queue.filter("status = 'open'").select(*keys), keys, "left_anti")


# --- the write path of pages -----------------------------------------------------------------------------------------------


def page_rows(fetched: DataFrame) -> DataFrame:
    """Rows of the store from answers: canonical_url, domain, title, path_hash, content_hash, raw_hash, word_count, source_type, content_flags, html, markdown, and what came with them. fetched: url, final_url, body (bytes), content_type, http_status, run, crawled_at."""
    rows = fetched.withColumns({"html": page_functions.decoded("body", "content_type"), "canonical_url": urls.canonical(F.coalesce("final_url", "url"))})
    rows = rows.withColumn("markdown", text.normalized_markdown(markup.html_to_markdown("html")))
    return _stored(rows.withColumn("raw_hash", F.sha2("body", 256)))


def _stored(rows: DataFrame) -> DataFrame:
    words = text.word_count(F.coalesce("markdown", F.lit("")))
    return rows.withColumns({
        "domain": urls.host("canonical_url"), "title": markup.title("html"), "path_hash": F.sha2("canonical_url", 256), "content_hash": F.sha2(F.coalesce("markdown", F.lit("")), 256),
        "word_count": words, "source_type": urls.source_type("canonical_url"), "content_flags": text.content_flags(F.coalesce("markdown", F.lit("")), "html", words),
    })


def ingested(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the store, errors (url, error)) from pages that were handed in as HTML or markdown: exactly one of the two, EINGEST otherwise. given: url, html, markdown, run, crawled_at."""
    error = F.when(F.col("html").isNull() == F.col("markdown").isNull(), "EINGEST").when(urls.rejection("url").isNotNull(), F.concat(F.lit("EBADURL:"), urls.rejection("url")))
    rows = given.withColumn("error", error)
    good = rows.filter("error IS NULL").drop("error").withColumns({"canonical_url": urls.canonical("url"), "raw_hash": F.sha2(F.coalesce("html", "markdown"), 256), "http_status": F.lit(200), "render_mode": F.lit("ingest")})
    md = F.when(F.col("html").isNull(), F.col("markdown")).otherwise(markup.html_to_markdown("html"))
    return _stored(good.withColumn("markdown", text.normalized_markdown(md))), rows.filter("error IS NOT NULL").select("url", "error")


def store_batch(current: DataFrame, incoming: DataFrame, citations: DataFrame, key: str = "url") -> dict[str, DataFrame]:
    """pages: the new snapshot, as page_upsert; page_versions: a row to append for each row that came in; review_queue: (kind, record_id, field_name) for citations of a text that has changed; reindex: the keys whose postings are to be replaced. current, incoming: key, digest, run; citations: key, doc_hash, record_id, field_name."""
    pages = page_upsert(current, incoming, key)
    stale = invalidated(pages, citations, key).select(F.lit("source_changed").alias("kind"), "record_id", "field_name")
    return {"pages": pages, "page_versions": incoming.select(key, "run", "digest"), "review_queue": stale, "reindex": pages.filter("action IN ('new', 'updated')").select(key)}


def stale_citations_of(citations: DataFrame, records: DataFrame, pages: DataFrame, source: str | None = None, key: str = "doc_url") -> DataFrame:
    """Stale citations with the source and section of their record; of one source where it is given. records: record_id, source, section."""
    owners = records.select("record_id", "source", "section")
    if source is not None:
        owners = owners.filter(F.col("source") == source)
    return stale_citations(citations, pages, key).join(owners, "record_id")


def stale_sweep(citations: DataFrame, pages: DataFrame, queue: DataFrame, key: str = "doc_url") -> DataFrame:
    """(kind, record_id, field_name, key) to queue: citations of pages that are gone (missing_source) or have another text now (stale_citation), without those that an open item of the queue has already."""
    now = pages.select(key, F.col("doc_hash").alias("__now"), F.lit(True).alias("__there"))
    stale = F.col("doc_hash").isNotNull() & (F.col("doc_hash") != F.col("__now"))
    kind = F.when(F.col("__there").isNull(), "missing_source").when(stale, "stale_citation")
    found = citations.join(now, key, "left").select(kind.alias("kind"), "record_id", "field_name", key).filter("kind IS NOT NULL")  # one join tells both
    return open_new_items(found.distinct(), queue, ["kind", "record_id", "field_name"])


def fsck(pages: DataFrame, bodies: DataFrame, indexed: DataFrame, records: DataFrame) -> DataFrame:
    """(check, key): what is wrong with a store. missing_body, orphan_body, hash_mismatch between pages (url, content_hash) and bodies (url, markdown); not_indexed, orphan_index between pages and the index's ids (url); bad_record for records (record_id, record) that are no JSON or have another id of their own."""
    found = lambda rows, check, key="url": rows.select(F.lit(check).alias("check"), F.col(key).alias("key"))
    with_body = pages.join(bodies, "url")
    out = found(pages.join(bodies, "url", "left_anti"), "missing_body").unionByName(found(bodies.join(pages, "url", "left_anti"), "orphan_body"))
    out = out.unionByName(found(with_body.filter(F.sha2("markdown", 256) != F.col("content_hash")), "hash_mismatch"))
    ids = indexed.select("url").distinct()
    out = out.unionByName(found(pages.join(ids, "url", "left_anti"), "not_indexed")).unionByName(found(ids.join(pages, "url", "left_anti"), "orphan_index"))
    own = F.get_json_object("record", "$.endpoint_id")
    return out.unionByName(found(records.filter(F.try_parse_json("record").isNull() | (own.isNotNull() & (own != F.col("record_id")))), "bad_record", "record_id"))


def owned_pages(pages: DataFrame, ownership: DataFrame, guess: Column) -> DataFrame:
    """pages with source: the owner in the scope tables (a page owned in two scopes is there twice), else the guess. ownership: url, owner."""
    return pages.join(ownership.select("url", "owner"), "url", "left").withColumn("source", F.coalesce("owner", guess)).drop("owner")


def by_domain(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """pages (domain) with source: what the map (domain, source) says, else the domain itself."""
    return pages.join(domains.select("domain", "source"), "domain", "left").withColumn("source", F.coalesce("source", "domain"))
