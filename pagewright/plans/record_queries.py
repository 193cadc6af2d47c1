"""Queries over records: building, checks, upserts, search, what pages say about them. Records are made from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from .registry import cases, dealt, parts_of, query, sql_cases, table, values

_ID = "sha256('acme|' || p_brand || '|http|https://h.example||GET|/p/' || p_partkey)"


_RECORDS = 50_000  # of a partition


def _built(spark, sf_dir):
    """A record for each part, cited from a page that has its name."""
    p = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), _RECORDS, "p_partkey")
    key = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("GET /p/"), key, F.lit(" "), F.col("p_name"))
    none = F.lit(None).cast("string")
    found = p.select(
        "p_partkey", F.lit("acme").alias("source"), F.col("p_brand").alias("section"), F.lit("https://h.example").alias("base_url"), F.lit("GET").alias("method"), F.concat(F.lit("/p/"), key).alias("path"), F.col("p_name").alias("description"),
        none.alias("request_schema"), F.when(F.col("p_size") > 25, F.concat(F.lit('{"weight":"'), F.col("p_size").cast("string"), F.lit('"}'))).alias("rate_limit"), F.concat(F.lit("https://d.example/"), key).alias("url"), F.lit("2024-01-01T00:00:00Z").alias("crawled_at"),
        F.sha2(body, 256).alias("content_hash"), F.sha2(F.concat(F.lit("https://d.example/"), key), 256).alias("path_hash"), F.substring(body, 5, 6).alias("excerpt"), F.lit(4).alias("excerpt_start"), F.least(F.lit(10), F.length(body)).alias("excerpt_end"),
    )
    pages = p.select(F.concat(F.lit("https://d.example/"), key).alias("url"), F.sha2(body, 256).alias("page_hash"), body.alias("page_text"), "p_partkey")
    return records.built(found), pages


@query(f"SELECT p_partkey, {_ID} AS record_id, 6 - CASE WHEN p_size > 25 THEN 0 ELSE 1 END - 1 AS n_cited, CASE WHEN p_size > 25 THEN 'documented' ELSE 'unknown' END AS rate_status FROM part")
def record_builder(spark, sf_dir):
    built, _ = _built(spark, sf_dir)
    return built.select("p_partkey", "record_id", F.size(records.citations(F.col("record"))).alias("n_cited"), records.statuses(F.col("record"))["rate_limit"].alias("rate_status"))


_BROKEN = """(1, '{"section":"s"'), (2, '[1]'), (3, '{"source":"a","section":"s","protocol":"smtp","field_status":{}}'), (4, '{"source":"a","section":"s","protocol":"ws","field_status":{"x":"maybe"}}'), (5, '{"source":"a","section":"s","protocol":"ws","field_status":{},"endpoint_id":"no"}'), (6, '{"source":"a","section":"s","protocol":"ws","field_status":{},"rate_limit":[1]}'), (7, '{"protocol":"ws"}'), (8, '{"source":"a","section":"s","protocol":"ws","field_status":{},"sources":[{"url":"u"}]}')"""


@query(f"SELECT row_id, error, n_messages FROM {sql_cases("(1, 'EBADJSON', 1), (2, 'EBADJSON', 1), (3, 'ESCHEMA', 1), (4, 'ESCHEMA', 1), (5, 'EIDMISMATCH', 0), (6, 'ESCHEMA', 1), (7, 'ESCHEMA', 3), (8, 'ESCHEMA', 1)", 'n, error, n_messages')}")
def record_check(spark, sf_dir):
    """A broken record for each part, in eight ways."""
    return cases(spark, sf_dir, _BROKEN, "id, record").withColumn("j", records.judged("record")).select("row_id", F.col("j.error").alias("error"), F.size("j.messages").alias("n_messages"))


def _batches(spark, sf_dir):
    """Every third part's record is in the store, all come in; some are spoilt, some pages have changed."""
    built, pages = _built(spark, sf_dir)
    k = F.col("p_partkey") % 7
    spoilt = F.when(k == 1, F.replace("record", F.lit('"method":"GET"'), F.lit('"method":"PUT"'))).when(k == 2, F.replace("record", F.lit('"field_name":"description"'), F.lit('"field_name":"other"'))).when(k == 3, F.replace("record", F.lit('"protocol":"http"'), F.lit('"protocol":"smtp"'))).otherwise(F.col("record"))
    changed = pages.select("url", F.when(k == 4, F.sha2(F.lit("new"), 256)).otherwise(F.col("page_hash")).alias("page_hash"), "page_text")
    current = built.filter("p_partkey % 3 = 0").select("record_id", "record", F.lit("2023").alias("updated_at"))
    return current, built.select("p_partkey", spoilt.alias("record"), F.lit("2024").alias("updated_at")), changed


@query(f"SELECT {_ID} AS record_id, CASE WHEN p_partkey % 7 IN (1, 2, 3, 4) THEN '2023' ELSE '2024' END AS updated_at FROM part WHERE p_partkey % 7 NOT IN (1, 2, 3, 4) OR p_partkey % 3 = 0")
def record_upsert(spark, sf_dir):
    current, incoming, pages = _batches(spark, sf_dir)
    return records.upsert(current, incoming, pages)[0].select("record_id", "updated_at")


@query("SELECT CASE p_partkey % 7 WHEN 1 THEN 'EIDMISMATCH' WHEN 2 THEN 'EBADCITE' WHEN 3 THEN 'ESCHEMA' ELSE 'ECITE:EHASH' END AS error, count(*) AS n FROM part WHERE p_partkey % 7 IN (1, 2, 3, 4) GROUP BY 1")
def record_rejects(spark, sf_dir):
    current, incoming, pages = _batches(spark, sf_dir)
    return records.upsert(current, incoming, pages)[1].groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT field_name, count(*) AS n, count(DISTINCT p_partkey) AS n_urls FROM (SELECT p_partkey, unnest(['http.method', 'http.path', 'http.base_url', 'description']) AS field_name FROM part UNION ALL SELECT p_partkey, 'rate_limit' FROM part WHERE p_size > 25) GROUP BY 1")
def record_lineage(spark, sf_dir):
    built, _ = _built(spark, sf_dir)
    cited = records.cited_rows(built).select("field_name", "doc_url")
    return records.field_counts(cited, parts_of(table(spark, sf_dir, "part"), _RECORDS))


_REVIEW = """(1, 'r§', '{"field_status":{"description":"unknown","rate_limit":"unknown"},"description":"text"}' ), (2, 'r§', '{"field_status":{"error_codes":"conflict","description":"documented"},"description":"x"}'), (3, 'r§', '{"field_status":{}}')"""


_REVIEW_EXPECTED = "(1, 'inconsistent_status', 'r§', 'description', 'value_without_status'), (2, 'inconsistent_status', 'r§', 'error_codes', 'conflict')"


@query(f"SELECT kind, record_id, field_name, reason FROM {sql_cases(_REVIEW_EXPECTED, 'n, kind, record_id, field_name, reason', ('record_id',), n=3)}")
def record_reviews(spark, sf_dir):
    """A record for each part, in three forms."""
    return records.review_items(cases(spark, sf_dir, _REVIEW, "n, record_id, record").select("record_id", "record"))


_TEXTS = """(1, '{"description":"Places an order §","rate_limit":{"weight":5,"unit":"s"},"error_codes":[{"code":-1013,"message":"bad"},{"code":7,"description":"worse"}],"required_permissions":["trade","read"]}'), (2, '{"rate_limit":"10/s","required_permissions":"read"}'), (3, '{}')"""


@query(f"SELECT row_id, text FROM {sql_cases("(1, 'Places an order §¶5¶s¶-1013¶bad¶7¶worse¶trade¶read'), (2, '10/s¶read'), (3, '')", 'n, text', ('text',))}")
def record_search_text(spark, sf_dir):
    """What is searched of a record for each part, in three forms."""
    return cases(spark, sf_dir, _TEXTS, "id, record").select("row_id", records.search_text(F.col("record")).alias("text"))


_TERMS = "(1, 'small'), (1, 'ring'), (2, 'widget'), (2, 'nowhere'), (3, 'p')"
_LIST = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query(f"""
WITH q AS (SELECT * FROM (VALUES {_TERMS}) AS t(query_id, term)), d AS (SELECT {_ID} AS doc_id, {_LIST.format(c="'/p/' || p_partkey")} AS a, {_LIST.format(c='p_name')} AS b FROM part),
l AS (SELECT doc_id, 2.0 * len(a) + len(b) AS len FROM d), s AS (SELECT count(*) AS n, avg(len) AS avg FROM l), t AS (SELECT doc_id, unnest(a) AS term, 2.0 AS w FROM d UNION ALL SELECT doc_id, unnest(b), 1.0 FROM d),
h AS (SELECT query_id, doc_id, term, sum(w) AS f FROM t JOIN q USING (term) GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM h GROUP BY ALL),
b AS (SELECT query_id, doc_id, count(*) AS k, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM h JOIN df USING (query_id, term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1, 2),
w AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), m AS (SELECT b.*, k = w.n AS whole FROM b JOIN w USING (query_id)), c AS (SELECT * FROM m WHERE whole OR query_id NOT IN (SELECT query_id FROM m WHERE whole))
SELECT query_id, round(score, 6) AS score, rank FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) WHERE rank <= 10""")
def record_search(spark, sf_dir):
    """A top-k report: records by path and name; where none has all terms, by any. Equal scores are told apart by id, which rounding may change, so ids are left out."""
    rows = _built(spark, sf_dir)[0].select("record_id", "source", "section", "path", F.col("description").alias("text"))
    return records.search(rows, values(spark, _TERMS, "query_id, term"), 10).select("query_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT DISTINCT p_brand AS source FROM part WHERE '/v' || p_size || '/x' ILIKE '%/V1%' ORDER BY 1 LIMIT 10")
def path_sources(spark, sf_dir):
    """The first ten sources that have a path (a report)."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.concat(F.lit("/v"), F.col("p_size").cast("string"), F.lit("/x")).alias("path"))
    return records.sources_of_path(rows, "/V1")


@query("SELECT p_partkey, p_brand AS source, method FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'get' ELSE 'POST' END AS method, CASE WHEN p_partkey % 3 = 0 THEN 'HTTPS://{{url}}' ELSE '' END || '/V1/' || (p_size % 4) AS path FROM part) WHERE (path ILIKE '/v1/3' OR path ILIKE '%{{url}}/v1/3') AND upper(method) = 'GET'")
def path_lookup(spark, sf_dir):
    """Records by path, letter case aside, also behind a variable for the host."""
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 3 == 0, F.lit("HTTPS://{{url}}")).otherwise(""), F.lit("/V1/"), (F.col("p_size") % 4).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source"), F.lit("s").alias("section"), F.when(k % 2 == 0, "get").otherwise("POST").alias("method"), path.alias("path"))
    return records.by_path(rows, "/v1/3", "GET").select("p_partkey", "source", "method")


@query("SELECT p_partkey AS record_id, p_name AS name, p_type AS type FROM part WHERE p_size % 2 = 0")
def parameters_backfill(spark, sf_dir):
    """Records of odd sizes have a schema; the others get the table behind their path, not the one before it."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    rows = p.select(F.col("p_partkey").alias("record_id"), F.concat(F.lit("/p/"), key).alias("path"), F.when(F.col("p_size") % 2 == 1, "{}").alias("request_schema"), F.concat(F.lit("https://d.example/"), key).alias("url"))
    md = F.concat(F.lit("| Name | Type |\n| --- | --- |\n| other | INT |\n\n"), F.repeat(F.lit("filler "), F.lit(100)), F.lit("\nGET /p/"), key, F.lit("\n\n## Parameters\n\n| Name | Type |\n| --- | --- |\n| "), "p_name", F.lit(" | "), "p_type", F.lit(" |\n"))
    pages = p.select(F.concat(F.lit("https://d.example/"), key).alias("url"), md.alias("md"))
    found = records.parameters_backfill(rows, pages)
    return found.select("record_id", F.inline("parameters")).select("record_id", "name", "type")


@query("SELECT p_partkey AS record_id, 'https://d.example/docs/' || p_partkey AS url, p_size::BIGINT AS weight FROM part")
def inferred_limits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    rows = p.select(F.col("p_partkey").alias("record_id"), F.concat(F.lit("/api/v1/thing"), key).alias("path"), F.lit("https://d.example/docs/").alias("prefix"))
    near = F.concat(F.lit("weight: 999\n"), F.repeat(F.lit("filler "), F.lit(60)), F.lit("GET /api/v1/thing"), key, F.lit(" has\nWeight: "), F.col("p_size").cast("string"))
    pages = p.select(F.concat(F.lit("https://d.example/docs/"), key).alias("url"), near.alias("md")).withColumn("origin", F.lit("https://d.example/"))
    return records.inferred_limits(rows, pages)
