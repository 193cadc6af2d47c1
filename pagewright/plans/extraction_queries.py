"""Queries over chunks, endpoints, dated entries and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import extraction
from .registry import cases, query, sql_cases, table


@query("""
WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 1536) / 1344.0), 0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, i AS chunk_index, i * 1344 AS char_start, least(i * 1344 + 1536, length(text)) AS char_end, sha256(substr(text, i * 1344 + 1, 1536)) AS chunk_hash FROM d""")
def chunk_documents(spark, sf_dir):
    rows = extraction.windows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("chunk", 256).alias("chunk_hash"))


@query()
def chunk_markdown(spark, sf_dir):
    """Pages as markdown, cut at headings and paragraphs."""
    pages = table(spark, sf_dir, "pages").select("page_id", markup.html_to_markdown("html").alias("md"), markup.title("html").alias("title"))
    chunks = extraction.chunks(pages, "page_id", "md").join(pages.select(F.col("page_id").alias("doc_id"), "title"), "doc_id")
    shown = extraction.with_context(F.col("chunk"), F.col("title"), F.col("heading"))
    return chunks.select(F.col("doc_id").alias("page_id"), "chunk_index", "char_start", "char_end", F.sha2(shown, 256).alias("chunk_hash"))


_API = "(1, '# GET /api/v3/order§¶text¶POST `/api/v3/order§/`¶GET /api/v3/order§?x=1'), (2, '## Place order (HTTP PUT, x)¶¶`https://h.example/v2/spot§`¶` DELETE /v1/p§/:id `'), (3, 'no endpoint'), (4, 'GET /a§/<id>).¶GET /a§/{x}'), (5, '## Cancel (HTTP DELETE)¶see /docs¶## Next¶```¶/v9/cancel§?id=1¶```¶```¶PATCH /v9/code§¶POST /v9/second¶```¶PATCH /v9/code§')"
_API_EXPECTED = "(1, 'GET', '/api/v3/order§', 'P4'), (1, 'POST', '/api/v3/order§', 'P1'), (2, 'PUT', '/v2/spot§', 'P3'), (2, 'DELETE', '/v1/p§/{id}', 'P5'), (4, 'GET', '/a§/{id}', 'P1'), (5, 'DELETE', '/v9/cancel§', 'P3'), (5, 'PATCH', '/v9/code§', 'P2')"
_PLANTED = sql_cases(_API_EXPECTED, "n, method, path, pattern", ("path",), "documents", "doc_id", 5)


def _planted(spark, sf_dir):
    """Every document, whole, below one of five pieces of documentation about its own endpoints."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("own"))
    return cases(spark, sf_dir, _API, "n, text", "documents", "doc_id").join(docs, "row_id").select(F.col("row_id").alias("doc_id"), F.concat("text", F.lit("\n\n## Text\n\n"), "own").alias("text"))


@query(f"SELECT row_id AS doc_id, method, path, pattern FROM {_PLANTED}")
def endpoint_scan(spark, sf_dir):
    """The prose names no endpoints, so those found are those put above it."""
    return extraction.endpoints(_planted(spark, sf_dir)).select("doc_id", "method", "path", "pattern")


@query(f"""
WITH e AS (SELECT method, regexp_replace(path, '\\{{[^}}]+\\}}', '{{}}', 'g') AS dedup_path, row_id AS doc_id FROM {_PLANTED})
SELECT method, dedup_path, min(doc_id) AS doc_id FROM e WHERE NOT (method = 'GET' AND starts_with(dedup_path, '/a')) OR (method = 'GET' AND starts_with(dedup_path, '/api')) GROUP BY 1, 2""")
def endpoint_new(spark, sf_dir):
    """Endpoints that the store does not hold yet; it holds GET /a<n>/{} of all parts' numbers."""
    docs = table(spark, sf_dir, "documents")
    existing = docs.select(F.lit("GET").alias("method"), F.concat(F.lit("/a"), F.col("doc_id").cast("string"), F.lit("/{}")).alias("dedup_path"))
    return extraction.new_endpoints(extraction.endpoints(_planted(spark, sf_dir)), existing).select("method", "dedup_path", "doc_id")


_LOG = "(1, 'https://a.example/§/log', 'intro¶# 2024-01-05¶first §¶# 2024-02-06 more¶second'), (2, 'https://a.example/§/prose', '## March 3rd, 2023¶one¶## April 2, 2023¶two §'), (3, 'https://a.example/2022-09-09/x§', 'single entry §'), (4, 'https://a.example/none§', 'nothing dated')"
_LOG_EXPECTED = "(1, 'https://a.example/§/log', 0, NULL, 'intro'), (1, 'https://a.example/§/log', 1, '2024-01-05', '# 2024-01-05¶first §'), (1, 'https://a.example/§/log', 2, '2024-02-06', '# 2024-02-06 more¶second'), (2, 'https://a.example/§/prose', 0, '2023-03-03', '## March 3rd, 2023¶one'), (2, 'https://a.example/§/prose', 1, '2023-04-02', '## April 2, 2023¶two §'), (3, 'https://a.example/2022-09-09/x§', 0, '2022-09-09', 'single entry §'), (4, 'https://a.example/none§', 0, NULL, 'nothing dated')"


@query(f"SELECT url, seq, entry_date, trim(entry, ' ' || chr(10)) AS entry FROM {sql_cases(_LOG_EXPECTED, 'n, url, seq, entry_date, entry', ('url', 'entry'), n=4)}")
def dated_entries(spark, sf_dir):
    """A changelog for each part, in four forms."""
    return extraction.dated_entries(cases(spark, sf_dir, _LOG, "n, url, md").select("url", "md")).select("url", "seq", "entry_date", F.trim(F.regexp_replace("entry", r"\s+\z", "")).alias("entry"))


@query("""
SELECT p_partkey AS id, CASE WHEN k < 4 THEN p_size END::BIGINT AS requests, CASE k WHEN 0 THEN s WHEN 1 THEN 1 WHEN 2 THEN s WHEN 3 THEN 60 * s END::BIGINT AS seconds, CASE WHEN k = 3 THEN p_size + 7 WHEN k = 4 THEN p_size END::BIGINT AS weight
FROM (SELECT p_partkey, p_size, p_partkey % 6 AS k, 1 + p_partkey % 5 AS s FROM part)""")
def rate_limits(spark, sf_dir):
    """A sentence about each part's limit, in six forms."""
    k, size, s = F.col("p_partkey") % 6, F.col("p_size").cast("string"), (1 + F.col("p_partkey") % 5).cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("Rate Limit: "), size, F.lit(" requests per "), s, F.lit(" seconds"))).when(k == 1, F.concat(F.lit("Limit: "), size, F.lit(" requests per second")))
        .when(k == 2, F.concat(size, F.lit(" times/"), s, F.lit("s"))).when(k == 3, F.concat(F.lit("Rate limit: "), size, F.lit(" calls / "), s, F.lit(" minutes, weight is "), (F.col("p_size") + 7).cast("string")))
        .when(k == 4, F.concat(F.lit("weight: "), size)).otherwise(F.col("p_name"))
    )
    requests, seconds = extraction.rate_limit(F.col("s"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("s")).select("id", requests.alias("requests"), seconds.alias("seconds"), extraction.weight(F.col("s")).alias("weight"))


_PARAMS = "(1, '| Parameter | Type | Required | Description |¶| --- | --- | --- | --- |¶| symbol§ | STRING | YES | the pair |¶| -leg§ | INT | no | |¶| side | ENUM | | |'), (2, 'Name¦Type¦Mandatory¶id§¦LONG¦true'), (3, 'no table')"
_PARAMS_EXPECTED = "(1, 'symbol§', 'STRING', true, NULL), (1, 'leg§', 'INT', false, 'symbol§'), (1, 'side', 'ENUM', NULL, NULL), (2, 'id§', 'LONG', true, NULL)"


@query(f"SELECT row_id, name, type, required, parent FROM {sql_cases(_PARAMS_EXPECTED, 'n, name, type, required, parent', ('name', 'parent'), n=3)}")
def parameter_tables(spark, sf_dir):
    """The parameters of each part's page, in three forms."""
    return cases(spark, sf_dir, _PARAMS, "n, md").select("row_id", F.inline(extraction.parameter_table("md"))).select("row_id", "name", "type", "required", "parent")


@query("""
WITH p AS (SELECT page_id, unnest([['id', 'LONG', 'true', NULL, '1'], ['order', 'OBJECT', 'true', NULL, '1'], ['side' || page_id, 'ENUM', 'true', 'order', '2'], ['leg', 'INT', 'false', 'order', '2'], ['price', 'DECIMAL', NULL, 'leg', '2'], ['limit', 'INT', 'false', NULL, '3']]) AS x FROM pages)
SELECT page_id, x[1] AS name, x[2] AS type, x[3]::BOOLEAN AS required, x[4] AS parent, x[5]::INT AS "table" FROM p WHERE x[5] <> '3' OR page_id % 2 = 0""")
def region_parameters(spark, sf_dir):
    """Every page's text, then an endpoint with its parameters in two or three tables; tables behind the section are another's."""
    said = (
        "## GET /x\n\n### Parameters\n\n| Name | Type | Required |\n| --- | --- | --- |\n| id | LONG | YES |\n| order | OBJECT | YES |\n\nThe fields of `order`:\n\n"
        "| Name | Type | Required |\n|---|---|---|\n| side§ | ENUM | YES |\n| leg | INT | NO |\n| - price | DECIMAL | |\n\n```\n| Name | Type |\n| no | table |\n```\n\n"
    )
    more, tail = "#### Paging\n\nName\tType\tRequired\nlimit\tINT\tno\n\n", "### Response\n\n| Name | Type |\n| --- | --- |\n| result | INT |\n"
    n = F.col("page_id")
    own = F.concat(F.lit("Text of its own.\n\n"), F.replace(F.lit(said), F.lit("§"), n.cast("string")), F.when(n % 2 == 0, more).otherwise(""), F.lit(tail))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("html"), F.lit("\n\n"), own).alias("md"), F.length("html").alias("at"))
    return p.select("page_id", F.inline(extraction.region_parameters("md", "at")).alias("name", "type", "required", "description", "parent", "table")).drop("description")


@query("SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', l_returnflag, l_linestatus, 'http', 'https://h.example', 'v1', 'GET', '/o/' || l_orderkey)) AS record_id FROM lineitem")
def record_ids(spark, sf_dir):
    c = F.col
    made = extraction.record_id(c("l_returnflag"), c("l_linestatus"), F.lit("http"), F.lit("https://h.example"), F.lit("v1"), F.lit("get"), F.concat(F.lit("/o/"), c("l_orderkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made.alias("record_id"))
