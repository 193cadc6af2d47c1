"""Readers: golden questions (JSONL), registries (YAML), sitemaps, API descriptions, request collections."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
MAX_REFERENCES = 20
MAX_NODES = 200_000

_S = T.StringType()


def jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of JSON lines; blank lines and those that start with # are left out."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.from_json("value", ddl).alias("r")).select("r.*")


def registry(spark: SparkSession, text: str) -> DataFrame:
    """A registry of sources as rows (source, name, domains, section, base_urls, seed_urls, mode, priority, scope); missing modes are "inventory", priorities 100. A registry is a file of some hundred entries that the driver reads."""
    import yaml

    rows = []
    for ex in (yaml.safe_load(text) or {}).get("sources") or []:
        for s in ex.get("sections") or [{}]:
            policy = s.get("inventory_policy") or {}
            rows.append((ex.get("id"), ex.get("name") or ex.get("id"), ex.get("allowed_domains") or [], s.get("id"), s.get("base_urls") or [], s.get("seed_urls") or [], policy.get("mode") or "inventory", int(policy.get("priority", 100)), policy.get("scope_group")))
    return spark.createDataFrame(rows, "source string, name string, domains array<string>, section string, base_urls array<string>, seed_urls array<string>, mode string, priority int, scope string")


def sitemap_urls(xml: Column) -> Column:
    """Array of structs (loc, lastmod, is_index): entries of a urlset or an index, with any namespace prefix; bare loc elements where neither is there."""
    name = r"(?:[A-Za-z0-9_]+:)?"
    entries = F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?:url|sitemap)>(.*?)</{name}(?:url|sitemap)>"), F.lit(1))
    index = xml.rlike(rf"<{name}sitemapindex[\s>]")
    field = lambda c, tag: F.nullif(F.trim(F.regexp_extract(c, rf"(?s)<{name}{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}{tag}>", 1)), F.lit(""))
    unescaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    # a lambda's variable holds the entries and the document's kind, so that the document is searched once, not once an entry
    found = lambda x: F.transform(x["entries"], lambda e: F.struct(unescaped(field(e, "loc")).alias("loc"), field(e, "lastmod").alias("lastmod"), x["index"].alias("is_index")))
    bare = F.transform(F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}loc>\s*(.*?)\s*</{name}loc>"), F.lit(1)), lambda u: F.struct(unescaped(u).alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.lit(False).alias("is_index")))
    parsed = F.transform(F.array(F.struct(entries.alias("entries"), index.alias("index"))), lambda x: F.when(F.size(x["entries"]) > 0, found(x)).otherwise(bare))
    return F.filter(F.get(parsed, F.lit(0)), lambda e: e["loc"].isNotNull())


def sitemap_bytes(content: Column) -> Column:
    """The XML of plain or gzipped bytes."""
    return _unzipped(content)


@F.pandas_udf(_S)
def _unzipped(content: pd.Series) -> pd.Series:
    import gzip

    return content.map(lambda b: (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace"), na_action="ignore")


def load_spec(text: str) -> dict:
    """JSON where it starts with a brace, else YAML with tabs as four blanks; it must be an object."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same rules; the C parser where PyYAML has it
    spec = json.loads(text) if text.lstrip().startswith("{") else yaml.load(text.replace("\t", "    "), loader)
    if not isinstance(spec, dict):
        raise ValueError("EBADSPEC: not an object")
    return spec


def resolve(node: Any, root: dict, depth: int = 0, left: list[int] | None = None) -> Any:
    """References within the document are put in their place, up to MAX_REFERENCES deep; others stay. A document that grows beyond MAX_NODES that way is refused."""
    left = [MAX_NODES] if left is None else left
    left[0] -= 1
    if left[0] < 0:
        raise ValueError("ETOOLARGE: references make too large a document")
    if isinstance(node, dict):
        if set(node) == {"$ref"} and isinstance(node["$ref"], str) and node["$ref"].startswith("#/") and depth < MAX_REFERENCES:
            target: Any = root
            for part in node["$ref"][2:].split("/"):
                part = part.replace("~1", "/").replace("~0", "~")
                if not isinstance(target, dict) or part not in target:
                    return node
                target = target[part]
            return resolve(target, root, depth + 1, left)
        return {k: resolve(v, root, depth, left) for k, v in node.items()}
    return [resolve(v, root, depth, left) for v in node] if isinstance(node, list) else node


_OPERATION = T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("method", "path", "base_url", "api_version", "description", "request_schema", "response_schema", "excerpt")] + [T.StructField("excerpt_start", T.IntegerType()), T.StructField("excerpt_end", T.IntegerType()), T.StructField("error", _S)]))


def excerpt_in(text: str, path: str, size: int = 550) -> tuple[str, int, int] | None:
    """What stands where a path is defined."""
    for anchor in (f"\n  {path}:", f"\n{path}:", f'"{path}"', path):
        if (at := text.find(anchor)) >= 0:
            start = at + (len(anchor) - len(anchor.lstrip("\n")))
            return text[start : start + size], start, min(start + size, len(text))
    return None


def operations(text: str | None) -> list[dict]:
    """A row for each path and method of an API description; a text that is none gives one row with an error."""
    try:
        spec = load_spec(text or "")
        servers = spec.get("servers") or []
        base = servers[0].get("url") if servers and isinstance(servers[0], dict) else (f"{(spec.get('schemes') or ['https'])[0]}://{spec['host']}{spec.get('basePath', '')}" if spec.get("host") else None)
        out = []
        for path, item in (spec.get("paths") or {}).items():
            item = resolve(item, spec)
            for method in METHODS if isinstance(item, dict) else ():
                if not isinstance(op := item.get(method), dict):
                    continue
                cited = excerpt_in(text, path)
                request = {"parameters": (item.get("parameters") or []) + (op.get("parameters") or []), "requestBody": op.get("requestBody")}
                out.append({"method": method.upper(), "path": path, "base_url": base, "api_version": str((spec.get("info") or {}).get("version") or "") or None, "description": op.get("summary") or op.get("description"),
                            "request_schema": json.dumps(resolve(request, spec), sort_keys=True, default=str), "response_schema": json.dumps(resolve(op.get("responses"), spec), sort_keys=True, default=str),
                            "excerpt": cited and cited[0], "excerpt_start": cited and cited[1], "excerpt_end": cited and cited[2], "error": None})
        return out
    except Exception as e:  # noqa: BLE001 - whatever a foreign file makes a parser raise is that row's error
        return [{"error": f"EBADSPEC: {type(e).__name__}"}]


def requests_in(text: str | None) -> list[dict]:
    """A row for each request of a collection, folders flattened: method, path, base_url, description, request_schema (parameters by name and place, each once)."""
    try:
        out: list[dict] = []

        def walk(items: list) -> None:
            for item in items or []:
                if isinstance(item, dict) and isinstance(item.get("item"), list):
                    walk(item["item"])
                elif isinstance(item, dict) and isinstance(r := item.get("request"), dict):
                    url = r.get("url")
                    raw = url.get("raw", "") if isinstance(url, dict) else str(url or "")
                    body = r.get("body") or {}
                    found = [(p.get("key"), "query") for p in (url.get("query") if isinstance(url, dict) else None) or []]
                    found += [(p.get("key"), mode) for mode in ("urlencoded", "formdata") for p in body.get(mode) or []]
                    if body.get("mode") == "raw":
                        try:
                            found += [(k, "body") for k in json.loads(body.get("raw") or "{}")]
                        except (ValueError, TypeError):
                            pass
                    plain = raw.split("?", 1)[0]
                    at = plain.find("/", plain.find("://") + 3) if "://" in plain else plain.find("/")
                    base, path = (plain[:at], plain[at:]) if at >= 0 else (plain, "/")
                    parameters = [{"name": k, "in": w} for k, w in dict.fromkeys(x for x in found if x[0])]
                    out.append({"method": str(r.get("method") or "GET").upper(), "path": path, "base_url": base, "description": item.get("name"), "request_schema": json.dumps({"parameters": parameters}, sort_keys=True), "error": None})

        walk(json.loads(text or "")["item"])
        return out
    except (ValueError, KeyError, TypeError) as e:
        return [{"error": f"EBADSPEC: {type(e).__name__}"}]


@F.pandas_udf(_OPERATION)
def openapi_operations(text: pd.Series) -> pd.Series:
    return text.map(operations)


@F.pandas_udf(_OPERATION)
def collection_requests(text: pd.Series) -> pd.Series:
    return text.map(requests_in)


def import_specs(files: DataFrame, kind: str = "openapi", content: str = "content") -> DataFrame:
    """Files (other columns, content text) to records, a row each; rows with an error keep the file's columns. Files are dealt out first: parsing costs far more than their bytes tell Spark."""
    parse = openapi_operations if kind == "openapi" else collection_requests
    keep = [c for c in files.columns if c != content]
    dealt = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(content))
    return dealt.select(*keep, F.inline(parse(content)))
