"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: What marks a URL as no document.
BAD_SCHEMES = ("javascript", "mailto", "tel", "data", "ftp")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp")
BINARY_EXTENSIONS = (".pdf", ".zip", ".tar", ".gz", ".exe", ".dmg", ".deb", ".rpm")
STATIC_EXTENSIONS = (".css", ".woff", ".woff2", ".ttf", ".eot")
SCRIPT_EXTENSIONS = (".js", ".mjs", ".cjs")
ADMIN_SEGMENTS = ("/cdn-cgi/", "/wp-admin/")
TEMPLATE = r"\{\{.*?\}\}|\{%.*?%\}|\$\{.*?\}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ASSET_PATH = r"(?:/assets/|/static/|/_next/|/dist/|/build/|/chunks?/|/bundle)"
MAX_LENGTH = 4096

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(c: Column | str, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where it is missing (RFC 3986, appendix B)."""
    return F.regexp_extract(col(c), "(?s)" + _PARTS, i)


def host(c: Column | str) -> Column:
    """Lower-cased, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(c, 2), r"^.*@", ""), r":\d*$", ""))


def path_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def without_dot_segments(path: Column) -> Column:
    """Empty and "." segments go, ".." with the segment before it; a slash at the end stays."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.rlike(r"[^/].*/$") & (F.size(kept) > 0), "/").otherwise(""))


def canonical(c: Column | str) -> Column:
    """Lower-cased scheme (https where missing) and host, no user, default port or fragment, a normal path, the query as it is."""
    c = F.trim(col(c))
    scheme = F.when(part(c, 1) == "", "https").otherwise(F.lower(part(c, 1)))
    port = F.regexp_extract(F.regexp_replace(part(c, 2), r"^.*@", ""), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    query = F.when(part(c, 4) != "", F.concat(F.lit("?"), part(c, 4))).otherwise("")
    return F.concat(scheme, F.lit("://"), host(c), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), without_dot_segments(part(c, 3)), query)


def rejection(c: Column | str) -> Column:
    """Why the URL is no document, the first reason that holds; null if it may be one."""
    u = F.trim(F.coalesce(col(c), F.lit("")))
    scheme, path = F.lower(part(u, 1)), part(u, 3)
    low, ext = F.lower(path), path_extension(path)
    reason = (
        F.when(u == "", "empty").when(u.startswith("#"), "fragment_only").when(u.rlike(CONTROL), "control_chars")
        .when(F.length(u) > MAX_LENGTH, "too_long").when(u.rlike(TEMPLATE), "template_artifact")
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*\[[^\]/?#]*(?:[/?#]|$)"), "unparseable")
        .when(scheme.isin(*BAD_SCHEMES), F.concat(F.lit("bad_scheme:"), scheme))
        .when(scheme.isin("http", "https") & (host(u) == ""), "no_hostname")
    )
    for s in ADMIN_SEGMENTS:
        reason = reason.when(low.contains(s), "cdn_admin_path:" + s.strip("/"))
    reason = reason.when(ext.isin(*IMAGE_EXTENSIONS, *BINARY_EXTENSIONS, *STATIC_EXTENSIONS), F.concat(F.lit("resource_ext:"), ext))
    return reason.when(ext.isin(*SCRIPT_EXTENSIONS) & low.rlike(ASSET_PATH), F.concat(F.lit("js_asset:"), ext))


def in_domains(c: Column | str, domains: list[str]) -> Column:
    """The host is one of the domains or under one. No domains: nothing is."""
    out = F.lit(False)
    for d in domains:
        out = out | (host(c) == d) | host(c).endswith("." + d)
    return out


def in_scope(c: Column | str, prefixes: list[str]) -> Column:
    """Any prefix fits; without prefixes everything is in scope."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | col(c).startswith(p)
    return out


def origin(c: Column | str) -> Column:
    """Up to the first slash behind the ninth character."""
    c = col(c)
    return F.substring(c, F.lit(1), F.instr(F.substring(c, 9, 1 << 20), "/") + 8)


def directory(c: Column | str) -> Column:
    """Without query and fragment, up to the last slash, if that is behind the scheme."""
    plain = F.regexp_replace(col(c), r"[?#].*$", "")
    return F.when(plain.rlike(r"^.{9,}/"), F.regexp_extract(plain, r"^(.*/)", 1)).otherwise(plain)


def source_type(c: Column | str) -> Column:
    c = col(c)
    low = F.lower(c)
    spec = low.contains("openapi") | low.contains("swagger") | (c.rlike(r"\.(yaml|json)$") & low.rlike("spec|api|rest"))
    return (
        F.when(spec, "spec").when(c.contains("github.com/") | c.contains("raw.githubusercontent.com/"), "github_repo")
        .when(c.contains("llms.txt") | c.contains("llms-full.txt"), "llms_txt").when(c.contains("docs.ccxt.com/"), "ccxt_ref").otherwise("official_docs")
    )


def _or_root(x: Column) -> Column:
    """An empty path as /. One expression, as a condition's two sides would each work out the path again, and once more for every one within another."""
    return F.regexp_replace(x, r"\A\z", "/")


def normalized_api_path(c: Column | str) -> Column:
    """No query, invisible characters or closing signs; <p> and :p as {p}; no slash at the end."""
    x = F.regexp_replace(col(c), "[​‌‍﻿]", "")
    x = F.regexp_replace(x, r"\?.*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"<([^>]+)>", "{$1}"), r"(?<=/):([A-Za-z_][A-Za-z0-9_]*)", "{$1}")
    x = F.regexp_replace(F.regexp_replace(x, r"[)\],.]+$", ""), "/+$", "")
    return _or_root(x)


def path_for_dedup(c: Column | str) -> Column:
    """As above, without scheme and host or a {{variable}} at the start, all parameters alike."""
    x = F.regexp_replace(normalized_api_path(c), r"^https?://[^/]*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^\{\{[^}]*\}\}", ""), r"\{[^}]+\}", "{}")
    x = F.regexp_replace(x, "/+$", "")
    return _or_root(x)


def discovery_kind(c: Column | str) -> Column:
    low = F.lower(col(c))
    return (
        F.when(low.contains("sitemap") & low.contains(".xml"), "sitemap").when(low.contains("postman"), "postman").when(low.contains("asyncapi"), "asyncapi")
        .when(low.contains("openapi") | low.contains("swagger"), "openapi").when(low.rlike(r"\.(json|ya?ml)$"), "spec_candidate")
    )


def eval_form(c: Column | str) -> Column:
    """Percent signs decoded, no fragment or slash at the end: how expected and found URLs are compared."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.try_url_decode(col(c)), col(c)), "#.*$", ""), "/+$", "")
