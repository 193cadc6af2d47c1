"""Records of documented endpoints: building, checking, upserting, searching.

A record is JSON: exchange or source, section, protocol, http (method, path, base_url, api_version), description,
request_schema, response_schema, required_permissions, rate_limit, error_codes, field_status (field to documented,
undocumented, unknown or conflict) and sources (citations with field_name). A record that breaks a rule goes to the rejected side with
its code, all others into the new snapshot.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from . import extraction, lexical, lineage

#: What a record may say.
PROTOCOLS = ("http", "ws", "rpc", "other")
STATUSES = ("documented", "undocumented", "unknown", "conflict")
REQUIRED = ("section", "protocol", "field_status")
OBJECTS = ("request_schema", "response_schema", "required_permissions", "rate_limit")
CITATION = ("url", "crawled_at", "content_hash", "path_hash", "excerpt", "excerpt_start", "excerpt_end")
HTTP_FIELDS = ("http.method", "http.path", "http.base_url", "description", "request_schema", "response_schema", "required_permissions", "rate_limit", "error_codes")
MOST_MESSAGES = 10

_SOURCE = "array<struct<url:string,crawled_at:string,content_hash:string,path_hash:string,excerpt:string,excerpt_start:int,excerpt_end:int,field_name:string>>"


def field(record: Column, path: str) -> Column:
    return F.get_json_object(record, f"$.{path}")


def statuses(record: Column) -> Column:
    return F.from_json(field(record, "field_status"), "map<string,string>")


def citations(record: Column) -> Column:
    return F.from_json(field(record, "sources"), _SOURCE)


def messages(record) -> list[str]:
    """What a parsed record breaks of its schema, at most MOST_MESSAGES; empty for a good one."""
    if not isinstance(record, dict):
        return ["not an object"]
    has = {k for k, v in record.items() if v is not None}
    out = [f"'{n}' is a required property" for n in REQUIRED if n not in has]
    if not has & {"source", "exchange"}:
        out.append("'source' is a required property")
    if "protocol" in has and record["protocol"] not in PROTOCOLS:
        out.append(f"protocol: not one of {', '.join(PROTOCOLS)}")
    out += [f"{n}: not an object or null" for n in ("http", *OBJECTS) if n in has and not isinstance(record[n], dict)]
    out += [f"{n}: not an array or null" for n in ("error_codes", "sources") if n in has and not isinstance(record[n], list)]
    status = record.get("field_status")
    if "field_status" in has and (not isinstance(status, dict) or any(v not in STATUSES for v in status.values())):
        out.append(f"field_status: not one of {', '.join(STATUSES)}")
    cites = record.get("sources")
    if isinstance(cites, list) and any(not isinstance(c, dict) or any(c.get(n) is None for n in CITATION) for c in cites):
        out.append("sources: a citation lacks a required property")
    return out[:MOST_MESSAGES]


def identity(record: dict) -> str:
    """SHA-256 of the seven parts joined by bars; the last four are empty for other protocols than http."""
    http = (record.get("http") or {}) if record.get("protocol") == "http" else {}
    parts = [record.get("exchange") or record.get("source"), record.get("section"), record.get("protocol"), http.get("base_url"), http.get("api_version"), str(http.get("method") or "").upper(), http.get("path")]
    return hashlib.sha256("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def judge(text: str | None) -> tuple[str | None, str | None, list[str]]:
    """(id, error, messages) of a record by itself. The first rule that it breaks: EBADJSON, ESCHEMA, EIDMISMATCH, EBADHTTP, EBADFIELDSTATUS (a key or a documented value is missing), EBADCITE (a documented field without a citation); null for a good one."""
    try:
        record = json.loads(text or "")
    except ValueError:
        record = None
    found = messages(record)
    if not isinstance(record, dict):
        return None, "EBADJSON", found
    if found:
        return None, "ESCHEMA", found
    own, status = identity(record), record["field_status"]

    def value(path: str):
        node = record
        for part in path.split("."):
            node = node.get(part) if isinstance(node, dict) else None
        return node

    documented = [n for n, s in status.items() if s == "documented"]
    cited = {c.get("field_name") for c in record.get("sources") or []}
    is_http = record["protocol"] == "http"
    rules = (
        ("EIDMISMATCH", record.get("endpoint_id") != own), ("EBADHTTP", is_http and not record.get("http")), ("EBADFIELDSTATUS", is_http and any(n not in status for n in HTTP_FIELDS)),
        ("EBADCITE", any(n not in cited for n in documented)), ("EBADFIELDSTATUS", any(value(n) is None or isinstance(value(n), str) and not value(n).strip() for n in documented)),
    )
    return own, next((code for code, broken in rules if broken), None), []


@F.pandas_udf(T.StructType([T.StructField("record_id", T.StringType()), T.StructField("error", T.StringType()), T.StructField("messages", T.ArrayType(T.StringType()))]))
def judged(record: pd.Series) -> pd.DataFrame:
    """A record is parsed once for all rules."""
    return pd.DataFrame([judge(t) for t in record], columns=["record_id", "error", "messages"])


def cited_rows(records: DataFrame) -> DataFrame:
    """(record_id, field_name, doc_url, doc_hash, and the excerpt): a row for each citation that names a field. records: record_id, record."""
    rows = records.select("record_id", F.explode(citations(F.col("record"))).alias("s"))
    return rows.filter("s.field_name IS NOT NULL").select("record_id", "s.field_name", F.col("s.url").alias("doc_url"), F.col("s.content_hash").alias("doc_hash"), "s.path_hash", "s.excerpt", "s.excerpt_start", "s.excerpt_end")


def field_counts(cited: DataFrame, parts: int) -> DataFrame:
    """(field_name, n, n_urls): citations and distinct URLs of a field. A field's citations of a URL are dealt to one of so many partitions, which then counts them whole, so only a row a field and partition is added up."""
    one = cited.repartition(parts, "field_name", "doc_url").groupBy("field_name", "doc_url").agg(F.count("*").alias("n"))
    return one.groupBy("field_name").agg(F.sum("n").alias("n"), F.count("doc_url").alias("n_urls"))


def checked(records: DataFrame, pages: DataFrame) -> DataFrame:
    """records (record) with record_id and error: the record's own rules, then ECITE where a citation does not hold against the pages (url, page_hash, page_text)."""
    rows = records.withColumn("__j", judged("record")).withColumns({"record_id": F.col("__j.record_id"), "error": F.col("__j.error")}).drop("__j")
    cites = rows.filter("error IS NULL").select("record_id", F.explode(citations(F.col("record"))).alias("s")).select("record_id", F.col("s.url").alias("url"), "s.content_hash", "s.excerpt", "s.excerpt_start", "s.excerpt_end")
    broken = lineage.verify_citations(cites, pages, "url").filter("error IS NOT NULL").groupBy("record_id").agg(F.min("error").alias("__cite"))
    out = rows.join(broken, "record_id", "left")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("__cite").isNotNull(), F.concat(F.lit("ECITE:"), "__cite")))).drop("__cite")


def upsert(current: DataFrame, incoming: DataFrame, pages: DataFrame, order: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejected). Good records replace those with their id, of several the last by `order`; rejected: record, error. current: record_id, record, order."""
    judged = checked(incoming, pages)
    good = judged.filter("error IS NULL").groupBy("record_id").agg(F.max(F.struct(order, "record")).alias("r")).select("record_id", "r.record", f"r.{order}")
    kept = current.select("record_id", "record", order).join(good.select("record_id"), "record_id", "left_anti")
    return kept.unionByName(good), judged.filter("error IS NOT NULL").select("record_id", "record", "error")


def review_items(records: DataFrame) -> DataFrame:
    """(kind, record_id, field_name, reason): a field said to be undocumented or unknown that has a value, or in conflict."""
    rows = records.select("record_id", "record", F.explode(statuses(F.col("record"))).alias("field_name", "status"))
    values = F.create_map(*(x for n in HTTP_FIELDS for x in (F.lit(n), field(F.col("record"), n))))
    has = F.trim(F.coalesce(values[F.col("field_name")], F.lit(""))) != ""
    reason = F.when(F.col("status") == "conflict", "conflict").when(F.col("status").isin("undocumented", "unknown") & has, "value_without_status")
    return rows.select(F.lit("inconsistent_status").alias("kind"), "record_id", "field_name", reason.alias("reason")).filter("reason IS NOT NULL")


def built(found: DataFrame) -> DataFrame:
    """found (source, section, base_url, method, path, description, request_schema, rate_limit as JSON, url, crawled_at, content_hash, path_hash, excerpt, excerpt_start, excerpt_end) with record_id and record.

    Method and path are documented and cited; a description, a schema and a rate limit are, where there is one, with the same citation; all else is unknown.
    """
    c = F.col
    rid = extraction.record_id(c("source"), c("section"), F.lit("http"), c("base_url"), F.lit(""), c("method"), c("path"))
    given = {"http.method": c("method"), "http.path": c("path"), "http.base_url": c("base_url"), "description": c("description"), "request_schema": c("request_schema"), "rate_limit": c("rate_limit")}
    is_documented = lambda n: F.trim(F.coalesce(given[n], F.lit(""))) != "" if n in given else F.lit(False)
    status = F.create_map(*(x for n in HTTP_FIELDS for x in (F.lit(n), F.when(is_documented(n), "documented").otherwise("unknown"))))
    cite = lambda n: F.when(is_documented(n), F.struct("url", "crawled_at", "content_hash", "path_hash", "excerpt", "excerpt_start", "excerpt_end", F.lit(n).alias("field_name")))
    parsed = lambda name: F.from_json(c(name), "map<string,string>")
    http = F.struct("method", "path", "base_url")
    record = F.to_json(F.struct("source", "section", F.lit("http").alias("protocol"), rid.alias("endpoint_id"), http.alias("http"), "description", parsed("request_schema").alias("request_schema"), parsed("rate_limit").alias("rate_limit"), status.alias("field_status"), F.array_compact(F.array(*(cite(n) for n in given))).alias("sources")))
    return found.withColumns({"record_id": rid, "record": record})


def search_text(record: Column) -> Column:
    """What a record is searched by: values alone, no keys and no parameters. Description, rate limit, codes with messages, permissions; a line each."""
    f = lambda p: field(record, p)
    limit = F.coalesce(F.map_values(F.from_json(f("rate_limit"), "map<string,string>")), F.array(f("rate_limit")))
    codes = F.from_json(f("error_codes"), "array<struct<code:string,message:string,description:string>>")
    pairs = F.flatten(F.transform(codes, lambda e: F.array(e["code"], F.coalesce(F.nullif(e["message"], F.lit("")), e["description"]))))
    permissions = F.from_json(f("required_permissions"), "array<string>")
    empty = F.array().cast("array<string>")
    parts = F.concat(F.array(f("description")), F.coalesce(F.when(f("rate_limit").isNotNull(), limit), empty), F.coalesce(pairs, empty), F.coalesce(F.when(f("required_permissions").startswith("["), permissions), F.array(f("required_permissions"))))
    return F.array_join(F.filter(parts, lambda s: s.isNotNull() & (s != "")), "\n")


def search(records: DataFrame, queries: DataFrame, k: int, source: str | None = None, section: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 over path and search text. records: record_id, source, section, path, text; queries: query_id, term."""
    rows = records
    for name, value in (("source", source), ("section", section)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    scored = lexical.bm25(rows, queries, {"path": (F.col("path"), 2.0), "text": (F.col("text"), 1.0)}, "record_id")
    return lexical.top(lexical.with_or_fallback(scored, queries).select("query_id", "doc_id", "score"), k)


def by_path(records: DataFrame, path: str, method: str | None = None) -> DataFrame:
    """Records whose path is the given one, letter case aside and also behind a {{url}} variable; sorted by source, section and method."""
    like = lambda p: F.col("path").ilike(p)
    rows = records.filter(like(path) | like("%{{url}}" + path))
    if method is not None:
        rows = rows.filter(F.upper("method") == method.upper())
    return rows.orderBy("source", "section", "method", "path")


def sources_of_path(records: DataFrame, path: str, most: int = 10) -> DataFrame:
    """The first sources, by name, that have a record whose path holds the given one."""
    return records.filter(F.col("path").ilike(f"%{path}%")).select("source").distinct().orderBy("source").limit(most)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """As many partitions as a shuffle has, by key: Spark would join small compressed ones into one whose texts fill a task's memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def parameters_backfill(records: DataFrame, pages: DataFrame, region: int = 2_000, after: int = 3_000, before: int = 500) -> DataFrame:
    """(record_id, parameters): for records without a request schema, the parameter table near the place where their cited page names the path. records: record_id, path, request_schema, url; pages: url, md.

    The region starts at the path, or up to `before` characters ahead of it, where a table's heading may stand, and holds `region` characters behind the first heading within `after` that speaks of parameters, else behind the path.
    """
    lacking = records.filter(F.col("request_schema").isNull()).select("record_id", "path", "url")
    at = F.instr(F.lower("md"), F.lower("path"))
    rows = _dealt(lacking, "url").join(_dealt(pages.select("url", "md"), "url"), "url").withColumn("at", at).filter("at > 0")
    near = F.substring("md", F.greatest(F.col("at") - before, F.lit(1)), F.lit(before + after))
    heading = F.regexp_instr(near, F.lit(r"(?mi)^#{1,6}[^\n]*(?:param|request|argument|query|body)"))
    start = F.when(heading > 0, F.greatest(F.col("at") - before, F.lit(1)) + heading - 1).otherwise(F.col("at"))
    found = rows.select("record_id", extraction.parameter_table(F.substring("md", start, F.lit(region))).alias("parameters"))
    return found.filter(F.size("parameters") > 0)


def inferred_limits(records: DataFrame, pages: DataFrame, before: int = 200, after: int = 500) -> DataFrame:
    """(record_id, url, weight): for records whose rate limit is unknown, the weight that stands near the last segment of their path, on the first page by URL that says one. records: record_id, path, prefix; pages: url, md, origin. Records and pages meet by origin and by the segment as a word, so a page is not held against every record."""
    tail = F.lower(F.regexp_extract(F.regexp_replace("path", "/+$", ""), r"([^/]+)$", 1))
    wanted = records.select("record_id", "prefix", urls.origin("prefix").alias("origin"), tail.alias("word")).filter("word <> ''")
    words = pages.select("url", "origin", F.explode(F.array_distinct(F.split(F.lower("md"), r"[^\p{L}\p{N}_\-{}]+"))).alias("word"))
    pairs = wanted.join(words, ["origin", "word"]).filter(F.col("url").startswith(F.col("prefix"))).select("record_id", "word", "url")
    pairs = _dealt(pairs, "url").join(_dealt(pages.select("url", "md"), "url"), "url")
    window = F.substring("md", F.greatest(F.instr(F.lower("md"), F.col("word")) - before, F.lit(1)), F.lit(before + after))
    found = pairs.select("record_id", "url", extraction.weight(window).alias("weight")).filter("weight IS NOT NULL")
    return found.groupBy("record_id").agg(F.min(F.struct("url", "weight")).alias("f")).select("record_id", "f.url", "f.weight")
