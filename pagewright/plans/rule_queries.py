"""Queries over filters, politeness, boosts, samples, store folders and source formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, text, urls
from ..operators import extraction, fusion, inventory, matching, reports, store, vectors
from ..sources import formats, places
from ..sources import store as folders
from .inventory_queries import _CANON
from .registry import query, table
from .text_queries import _PARSED, _REASON, _all_urls

# --- filters and comparisons -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_name ILIKE '%i_g%'")
def store_filters(spark, sf_dir):
    """Equality where a value is given, then a part of the name with its wildcards."""
    rows = store.optional_filters(table(spark, sf_dir, "part"), p_brand="Brand#12", p_type=None)
    return store.ilike_filter(rows, "p_name", "i_g").select("p_partkey")


@query("SELECT page_id, starts_with(url, 'http://m.') OR starts_with(url, 'https://blog.') AS in_scope FROM pages")
def scoped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.in_scope("url", ["http://m.", "https://blog."]).alias("in_scope"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '^.{9,}/') THEN regexp_extract(u, '^(.*/)', 1) ELSE u END AS directory FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)")
def page_directories(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.directory("url").alias("directory"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS before FROM lineitem")
def previous_values(spark, sf_dir):
    """Each part's quantity in the line before."""
    rows = store.previous(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_quantity", "before")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "before")


@query("SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40")
def set_differences(spark, sf_dir):
    side = lambda flag: table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") == flag) & (F.col("l_quantity") > 40)).select(F.col("l_partkey").alias("key"))
    return store.set_difference(side("R"), side("A"))


@query("SELECT 100 AS n, true AS known, true AS same_again FROM events HAVING count(*) >= 100")
def seeded_sample(spark, sf_dir):
    """A sampling operator: a hundred events by a seeded hash, the same ones at every run and in any order."""
    e = table(spark, sf_dir, "events").select("event_id")
    one, two = store.hash_sample(e, "event_id", 7, 100), store.hash_sample(e.repartition(5), "event_id", 7, 100)
    both = one.join(two.withColumn("again", F.lit(True)), "event_id", "left").join(e.distinct().withColumn("known", F.lit(True)), "event_id", "left")
    return both.agg(F.count("*").cast("int").alias("n"), F.min(F.coalesce("known", F.lit(False))).alias("known"), F.min(F.coalesce("again", F.lit(False))).alias("same_again"))


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM {_PARSED} GROUP BY 1 HAVING reason IS NOT NULL")
def rejected_entries(spark, sf_dir):
    return reports.rejected_urls(_all_urls(spark, sf_dir))


# --- politeness ------------------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN greatest(0, epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-15'))::DOUBLE END AS seconds FROM events""")
def retry_delays(spark, sf_dir):
    """Answers that name seconds, a date, nonsense or nothing."""
    k, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    header = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 2, "soon")
    rows = table(spark, sf_dir, "events").select("event_id", header.alias("h"))
    seconds = inventory.retry_after(F.col("h"), F.lit("2024-01-15").cast("timestamp"))
    return rows.select("event_id", F.when(F.col("h").isNotNull() & (F.col("h") != "soon"), seconds).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice >= 0.95 * 40000 OR coalesce(CASE WHEN l_linenumber > 1 THEN 3000 * l_quantity END > l_extendedprice, false) AS truncated FROM lineitem")
def truncated_answers(spark, sf_dir):
    """Prices stand for sizes: cut off at the limit, or shorter than declared."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    declared = F.when(F.col("l_linenumber") > 1, 3000 * F.col("l_quantity"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", inventory.truncated(F.col("l_extendedprice"), F.lit(40_000), declared).alias("truncated"))


@query("SELECT event_id, CASE WHEN s BETWEEN 200 AND 299 THEN 'parse' WHEN s BETWEEN 400 AND 499 THEN 'allow_all' ELSE 'deny_all' END AS policy FROM (SELECT event_id, 200 + user_id % 4 * 100 AS s FROM events)")
def robots_policies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", inventory.robots_policy(200 + F.col("user_id") % 4 * 100).alias("policy"))


@query("SELECT page_id, list_sort(list_distinct([url, 'https://s.example/' || page_id || '.xml'])) AS sitemaps FROM pages WHERE url IS NOT NULL")
def robots_lines(spark, sf_dir):
    """Sitemaps that each page's robots.txt names, one of them twice."""
    n = F.col("page_id").cast("string")
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: "), "url", F.lit("\n  SITEMAP : https://s.example/"), n, F.lit(".xml\nsitemap:"), "url", F.lit("\n# Sitemaps: none"))
    found = inventory.robots_sitemaps(robots)
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", F.array_sort(found).alias("sitemaps"))


_SITEMAPS = """
WITH u AS (SELECT regexp_extract(url, '^([a-z]+)', 1) || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' AS root, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS parts FROM pages),
l AS (SELECT root || array_to_string(parts[1:i], '/') || '/' AS base FROM (SELECT root, parts, unnest(range(1, least(len(parts), 3) + 1)) AS i FROM u))"""


@query(f"{_SITEMAPS} SELECT root || unnest({list(inventory.ROOT_SITEMAPS)}) AS url FROM u UNION SELECT base || unnest({list(inventory.PATH_SITEMAPS)}) FROM l")
def sitemap_candidates(spark, sf_dir):
    return inventory.sitemap_candidates(table(spark, sf_dir, "pages"))


# --- text, scores and boosts -----------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS question FROM conversations")
def normalized_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalized_question("text").alias("question"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN p_name WHEN 2 THEN 'Part ' || p_partkey END AS heading FROM part")
def headings_before(spark, sf_dir):
    """The last heading at three places: before all, behind the first, behind the second, which names the part."""
    k, head = F.col("p_partkey") % 3, F.concat(F.lit("intro\n# "), "p_name", F.lit("\ntext\n"))
    md = F.concat(head, F.lit("## Part "), F.col("p_partkey").cast("string"), F.lit("\nmore"))
    at = F.when(k == 0, 2).when(k == 1, F.length(head) - 2).otherwise(F.length(md) - 1)
    return table(spark, sf_dir, "part").select("p_partkey", extraction.heading_before(md, at).alias("heading"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 1 / (1 + c_acctbal) ELSE 0 END::DOUBLE AS score FROM customer")
def similarities(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", vectors.similarity(F.col("c_acctbal")).alias("score"))


_BOOSTED = "CASE page_id % 3 WHEN 0 THEN url || '/deprecated/x' ELSE url END"


@query(f"SELECT page_id, round(strlen(html) * CASE WHEN starts_with({_BOOSTED}, 'http://m.') THEN 1.3 ELSE 1 END * CASE WHEN page_id % 3 = 0 THEN 0.5 ELSE 1 END::DOUBLE, 6) AS score FROM pages")
def section_boosts(spark, sf_dir):
    """Pages of a section raised, deprecated ones lowered."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/deprecated/x"))).otherwise(F.col("url"))
    score = fusion.deprecated_demotion(fusion.section_boost(F.octet_length("html").cast("double"), url, F.lit("http://m.")), url)
    return table(spark, sf_dir, "pages").select("page_id", F.round(score, 6).alias("score"))


@query("""
SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 1 AS html, page_id % 4 >= 2 AS xml FROM pages""")
def response_kinds(spark, sf_dir):
    """Answers by their type, or by how they begin where none is given."""
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "Text/HTML; charset=utf-8").when(k == 2, "application/rss+xml")
    body = F.when(k == 1, F.concat(F.lit(" \n<!DOCTYPE html>"), "html")).when(k == 3, F.concat(F.lit("\ufeff<?xml version='1.0'?><x>"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", body.alias("b"), kind.alias("t"))
    return rows.select("page_id", matching.is_html(F.col("b"), F.col("t")).alias("html"), F.coalesce(matching.is_xml(F.col("b"), F.col("t")), F.lit(False)).alias("xml"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://new.example/' || page_id END AS target FROM pages")
def meta_refreshes(spark, sf_dir):
    """Every second page is replaced by one that leads elsewhere."""
    moved = F.concat(F.lit('<html><head><META http-equiv="refresh" content="5; URL=https://new.example/'), F.col("page_id").cast("string"), F.lit('"></head></html>'))
    return table(spark, sf_dir, "pages").select("page_id", markup.meta_refresh(F.when(F.col("page_id") % 2 == 0, moved).otherwise(F.col("html"))).alias("target"))


# --- store folders and formats ---------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n, count(DISTINCT canonical) AS n_urls, {folders.VERSION} AS version, 0 AS n_records, count(*) FILTER (canonical = (SELECT {_CANON} FROM pages ORDER BY page_id LIMIT 1)) AS n_first FROM (SELECT {_CANON} AS canonical FROM pages)")
def store_folder(spark, sf_dir):
    """A store is made, its page table filled, opened again in the newest schema and asked for one page."""
    folder = places.fresh(spark, "store")
    folders.init(spark, folder)
    p = table(spark, sf_dir, "pages")
    p.select(F.col("page_id").alias("id"), urls.canonical("url").alias("canonical_url"), "url", "html").write.mode("append").parquet(f"{folder}/pages")
    pages = folders.open_table(spark, folder, "pages")
    first = p.orderBy("page_id").first()["url"]
    found = folders.get_page(pages, first).agg(F.count("*").alias("n_first"))
    counts = pages.agg(F.count("*").alias("n"), F.countDistinct("canonical_url").alias("n_urls"), F.lit(folders.version(spark, folder)).alias("version"))
    records = folders.open_table(spark, folder, "records").agg(F.count("*").cast("int").alias("n_records"))
    return counts.crossJoin(records).crossJoin(found)  # of one row each


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark, sf_dir):
    """Turns appended to a log as JSON lines and read again, comments and blank lines left out."""
    path = places.fresh(spark, "log")
    folders.append_log(table(spark, sf_dir, "conversations"), path)
    spark.createDataFrame([("# a comment",), ("",), ("   ",)], "value string").write.mode("append").text(path)
    return formats.jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT change, count(*) AS n FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'changed' END AS change FROM nation) WHERE change IS NOT NULL GROUP BY 1")
def manifest_delta(spark, sf_dir):
    """A file for each nation, twice: a quarter of them is new, a quarter gone, a quarter another text."""
    rows, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4

    def written(df):
        path = places.fresh(spark, "files")
        df.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
        found = folders.manifest(spark, path)
        return found.filter("size > 0").withColumn("path", F.regexp_extract("path", r"(n_nationkey=\d+)", 1))

    old = written(rows.filter(k != 0).select("n_nationkey", F.col("n_name").alias("value")))
    new = written(rows.filter(k != 1).select("n_nationkey", F.when(k == 2, F.lower("n_name")).otherwise(F.col("n_name")).alias("value")))
    return folders.manifest_changes(old, new).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT 'n' || n_nationkey AS source, CASE WHEN n_nationkey % 2 = 0 THEN 's' END AS section, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 100 END AS priority, 'inventory' AS mode, n_name AS name FROM nation")
def registry_rows(spark, sf_dir):
    """A registry with an entry for each nation."""
    lines = [f"- id: n{r['n_nationkey']}\n  name: '{r['n_name']}'" + (f"\n  sections:\n  - id: s\n    inventory_policy: {{priority: {r['n_regionkey']}}}" if r["n_nationkey"] % 2 == 0 else "") for r in table(spark, sf_dir, "nation").collect()]
    return formats.registry(spark, "sources:\n" + "\n".join(lines)).select("source", "section", "priority", "mode", "name")


@query("""
SELECT p_partkey AS file, x.m AS method, '/a' || p_partkey AS path, 'https://h' || p_partkey || '.example' AS base_url, 'v' || p_size AS api_version, x.d AS description, true AS cited, CASE WHEN x.m = 'GET' THEN 'p' || p_partkey END AS parameter
FROM part, (SELECT unnest([{'m': 'GET', 'd': 'read'}, {'m': 'POST', 'd': 'write'}]) AS x) WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 0""")
def openapi_import(spark, sf_dir):
    """A description of each part's interface, as JSON, as YAML, or broken; a parameter stands behind a reference."""
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("§"), n), F.lit("¤"), F.col("p_size").cast("string"))
    json_ = '{"openapi": "3.0.0", "info": {"version": "v¤"}, "servers": [{"url": "https://h§.example"}], "paths": {"/a§": {"get": {"summary": "read", "parameters": [{"$ref": "#/components/parameters/p"}]}, "post": {"description": "write"}}}, "components": {"parameters": {"p": {"name": "p§", "in": "query"}}}}'
    yaml = "openapi: 3.0.0\ninfo:\n  version: v¤\nservers:\n- url: https://h§.example\npaths:\n  /a§:\n    get:\n      summary: read\n      parameters:\n      - $ref: '#/components/parameters/p'\n    post:\n      description: write\ncomponents:\n  parameters:\n    p:\n      name: p§\n"
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.when(k == 1, fill(json_)).when(k == 2, fill(yaml)).otherwise(F.lit("- a list")).alias("content"), fill(json_).alias("whole"), fill(yaml).alias("other"))
    rows = formats.import_specs(files)
    body = F.when(F.col("file") % 3 == 1, F.col("whole")).otherwise(F.col("other"))
    cited = F.when(F.col("error").isNull(), F.substring(body, F.col("excerpt_start") + 1, F.col("excerpt_end") - F.col("excerpt_start")) == F.col("excerpt"))
    parameter = F.nullif(F.regexp_extract("request_schema", r'"name": "(\w+)"', 1), F.lit(""))
    return rows.select("file", "method", "path", "base_url", "api_version", "description", cited.alias("cited"), parameter.alias("parameter"))


@query("SELECT p_partkey AS file, 'POST' AS method, '/v1/o' || p_partkey AS path, 'https://h.example' AS base_url, p_name AS description, '{\"parameters\": [{\"in\": \"query\", \"name\": \"x\"}, {\"in\": \"body\", \"name\": \"side\"}]}' AS request_schema FROM part")
def collection_import(spark, sf_dir):
    """A collection with one request in a folder for each part; a parameter that comes twice counts once."""
    n = F.col("p_partkey").cast("string")
    body = '{"item": [{"name": "folder", "item": [{"name": "¤", "request": {"method": "post", "url": {"raw": "https://h.example/v1/o§?x=1", "query": [{"key": "x"}, {"key": "x"}]}, "body": {"mode": "raw", "raw": "{\\"side\\": 1}"}}}]}]}'
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.replace(F.replace(F.lit(body), F.lit("§"), n), F.lit("¤"), F.col("p_name")).alias("content"))
    return formats.import_specs(files, "collection").select("file", "method", "path", "base_url", "description", "request_schema")
