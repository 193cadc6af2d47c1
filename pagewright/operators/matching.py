"""Matching of API paths: catalogues against records, documentation pages for records; request payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: Parts of URLs that are no page to cite, or a poor one.
SPEC_PARTS = ("raw.githubusercontent.com", "swagger", "openapi", "postman")
CHANGELOG_PARTS = ("change-log", "changelog", "release-note", "release_note", "migration-guide", "migration_guide")
POOR_PARTS = ("/zh-cn/", "/ja/", "/ko/", "/demo", "/quickstart", "/quick-start", "/overview/", "/testnet/", "/sandbox/")
FAQ_PARTS = ("/faq", "frequently-asked", "troubleshoot")
SKIPPED_SEGMENTS = ("v1", "v2", "v3", "v4", "v5", "api", "rest", "ws", "wss")

#: Lower-cased keys of a payload and the action they stand for, the first that fits.
PAYLOAD_ACTIONS = (
    (("asset", "address", "amount"), "withdraw"),
    (("coin", "address", "amount"), "withdraw"),
    (("side", "type", "quantity"), "place order"),
    (("side", "type", "price"), "place order"),
    (("side", "ordtype"), "place order"),
    (("side", "ordertype"), "place order"),
    (("ordtype", "orderqty"), "place order"),
    (("side", "qty"), "place order"),
    (("side", "size"), "place order"),
    (("side", "volume"), "place order"),
    (("side", "amount"), "place order"),
    (("leverage", "symbol"), "set leverage"),
    (("asset", "amount"), "transfer"),
    (("type", "channel"), "websocket subscribe"),
)

#: Keys of a payload that tell its source, the first that fits.
PAYLOAD_SOURCES = (
    ("okx", ("instId",)), ("okx", ("tdMode",)), ("okx", ("instType",)), ("bybit", ("category", "symbol")), ("bybit", ("category", "orderType")), ("kucoin", ("clientOid",)), ("kucoin", ("tradeType",)),
    ("bitget", ("marginCoin",)), ("bitget", ("productType",)), ("gateio", ("currency_pair",)), ("gateio", ("settle",)), ("kraken", ("pair", "ordertype")),
    ("bitmex", ("orderQty", "ordType")), ("bitmex", ("orderQty", "symbol")), ("bitstamp", ("currency_pair", "type")),
)


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def is_spec(url: Column) -> Column:
    low = F.lower(url)
    return _any(low, SPEC_PARTS) | F.regexp_replace(low, r"[?#].*$", "").rlike(r"\.ya?ml$")


def segments(path: Column) -> Column:
    skipped = F.array(*(F.lit(s) for s in SKIPPED_SEGMENTS))
    return F.filter(F.split(path, "/"), lambda s: (F.length(s) > 1) & ~F.array_contains(skipped, F.lower(s)))


def compared_path(path: Column) -> Column:
    """As path_for_dedup, every way of writing a parameter alike."""
    x = F.regexp_replace(urls.path_for_dedup(path), r":([A-Za-z_]\w*)", "{}")
    return F.regexp_replace(x, r"<[^>]+>", "{}")


def without_version(path: Column) -> Column:
    x = F.regexp_replace(path, r"^/(?:(?:[a-z]+)?api/)?v\d+(?:\.\d+)?", "")
    return F.when(x == "", "/").otherwise(x)


def cross_reference(catalogue: DataFrame, records: DataFrame) -> DataFrame:
    """(cat_path, rec_path, how, methods_agree): paths equal when normalised (exact), then, of what is left, equal without version (suffix; of several records the last by path), then what neither side has (null). Both: path, method."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(compared_path(F.col("path")).alias(f"{name}_path")).agg(F.array_sort(F.collect_set(F.upper("method"))).alias(f"{name}_methods"))

    a, b = side(catalogue, "cat"), side(records, "rec")
    exact = a.join(b, F.col("cat_path") == F.col("rec_path")).withColumn("how", F.lit("exact"))
    left = a.join(b, F.col("cat_path") == F.col("rec_path"), "left_anti").withColumn("suffix", without_version(F.col("cat_path")))
    right = b.join(a, F.col("cat_path") == F.col("rec_path"), "left_anti").groupBy(without_version(F.col("rec_path")).alias("suffix")).agg(F.max_by(F.struct("rec_path", "rec_methods"), "rec_path").alias("r"))
    near = left.join(right, "suffix", "left").select("cat_path", "cat_methods", F.col("r.rec_path").alias("rec_path"), F.col("r.rec_methods").alias("rec_methods"), F.when(F.col("r").isNotNull(), "suffix").alias("how"))
    used = near.filter("rec_path IS NOT NULL").select("rec_path")
    rest = b.join(a, F.col("cat_path") == F.col("rec_path"), "left_anti").join(used, "rec_path", "left_anti")
    rest = rest.select(F.lit(None).cast("string").alias("cat_path"), F.lit(None).cast("array<string>").alias("cat_methods"), "rec_path", "rec_methods", F.lit(None).cast("string").alias("how"))
    rows = exact.select("cat_path", "cat_methods", "rec_path", "rec_methods", "how").unionByName(near).unionByName(rest)
    return rows.select("cat_path", "rec_path", "how", (F.col("cat_methods") == F.col("rec_methods")).alias("methods_agree"))


def documentation_urls(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(record_id, url, score): of the pages that hold the record's path literally the best; specs and changelogs are none. records: record_id, path; pages: url, md.

    Candidates meet by the last segment of the path as a word of the page, so no page is held against every record.
    50 for the path in the URL, 10 for each segment in it, 30 for a page that names it at most twice and under ten other
    paths, -15 for over 30 paths, -20 and -40 for poor and FAQ pages, 1 for each slash of the URL.
    """
    known = records.withColumn("segments", segments(F.col("path"))).withColumn("word", F.lower(F.try_element_at("segments", F.lit(-1)))).filter("word IS NOT NULL")
    usable = pages.filter(~is_spec(F.col("url")) & ~_any(F.lower("url"), CHANGELOG_PARTS))
    word = usable.select("url", F.regexp_count("md", F.lit(r"(?:GET|POST|PUT|DELETE|PATCH)\s+/")).alias("n_paths"), "md")
    at = word.select("url", F.explode(F.array_distinct(F.split(F.lower("md"), r"[^\p{L}\p{N}_\-{}]+"))).alias("word"))
    pairs = known.join(at, "word").select("record_id", "path", "segments", "url").join(word, "url").filter(F.contains("md", "path"))
    mentions = (F.length("md") - F.length(F.replace("md", F.col("path"), F.lit("")))) / F.length("path")
    low = F.lower("url")
    score = (
        F.when(F.contains("url", "path"), 50).otherwise(0) + 10 * F.size(F.filter("segments", lambda s: F.contains(F.col("url"), s)))
        + F.when((mentions <= 2) & (F.col("n_paths") < 10), 30).when(F.col("n_paths") > 30, -15).otherwise(0)
        - F.when(_any(low, POOR_PARTS), 20).otherwise(0) - F.when(_any(low, FAQ_PARTS), 40).otherwise(0) + F.regexp_count("url", F.lit("/"))
    )
    ranked = pairs.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("score").desc(), "url")))
    return ranked.filter("r = 1").select("record_id", "url", "score")


def _first(keys: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for name, needed in reversed(table):
        out = F.when(F.size(F.array_intersect(keys, F.array(*(F.lit(k) for k in needed)))) == len(needed), name).otherwise(out)
    return out


def payload_action(payload: Column) -> Column:
    """What a JSON object's keys stand for; null for anything else."""
    return _first(F.transform(F.json_object_keys(payload), F.lower), [(a, k) for k, a in PAYLOAD_ACTIONS])


def payload_source(payload: Column) -> Column:
    keys = F.json_object_keys(payload)
    has = lambda *names: F.size(F.array_intersect(keys, F.array(*(F.lit(n) for n in names))))
    trading = F.array_contains(keys, "symbol") & ((has("timeInForce", "recvWindow", "timestamp") > 0) | (has("side", "type", "quantity", "price") >= 2))
    return F.coalesce(_first(keys, PAYLOAD_SOURCES), F.when(trading, "binance"))


def is_html(body: Column, content_type: Column) -> Column:
    start = F.lower(F.substring(F.regexp_replace(body, "^[﻿ \t\r\n]+", ""), 1, 100))
    return F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False)) | start.startswith("<!doctype") | start.startswith("<html")


def is_xml(body: Column, content_type: Column) -> Column:
    start = F.lower(F.substring(F.regexp_replace(body, "^[﻿ \t\r\n]+", ""), 1, 100))
    return F.coalesce(F.lower(content_type).rlike("xml|rss|atom"), F.lit(False)) | start.startswith("<?xml") | start.startswith("<rss") | start.startswith("<feed")
