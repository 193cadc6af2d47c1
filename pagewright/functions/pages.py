"""Functions over a page's text and bytes: decoding, escapes, line places, blocks, excerpts, canonical JSON."""

from __future__ import annotations

import bisect
import itertools
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

_S, _I = T.StringType(), T.IntegerType()


def charset(content_type: Column | str) -> Column:
    """What a content type names, lower-cased; utf-8 without it."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(col(content_type), r"(?i)charset=[\"']?([\w\-]+)", 1)), F.lit("")), F.lit("utf-8"))


@F.pandas_udf(_S)
def _decoded(body: pd.Series, name: pd.Series) -> pd.Series:
    import codecs

    def one(b, n):
        try:
            codecs.lookup(n)
        except LookupError:
            n = "utf-8"
        return None if b is None else bytes(b).decode(n, "replace")

    return pd.Series([one(b, n) for b, n in zip(body, name, strict=True)])


def decoded(body: Column | str, content_type: Column | str) -> Column:
    """Bytes as text by the content type's charset; unknown names count as utf-8, bytes that do not fit become U+FFFD."""
    return _decoded(col(body), charset(content_type))


def unescaped(c: Column | str) -> Column:
    r"""Literal \n and \t become line ends and tabs where there are more literal \n than line ends; \" becomes a quote."""
    c = col(c)
    count = lambda s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / len(s)
    lines = F.replace(F.replace(c, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
    return F.replace(F.when(count("\\n") > count("\n"), lines).otherwise(c), F.lit('\\"'), F.lit('"'))


def line_start(c: Column | str, line: Column) -> Column:
    """The place (characters from 0) where a line (from 1) starts; of a line beyond the last one, where the last starts."""
    lines = F.split(col(c), "\n")
    n = F.size(lines) - F.when(col(c).endswith("\n"), 1).otherwise(0)  # no line behind the last line end
    before = F.slice(lines, F.lit(1), F.greatest(F.when((line < 1) | (line > n), n).otherwise(line) - 1, F.lit(0)))
    return F.aggregate(before, F.lit(0), lambda a, s: a + F.length(s) + 1)


def heading_description(heading: Column | str, path: Column | str) -> Column:
    """A heading without HTTP methods, the path and markdown signs; null if nothing is left."""
    methods = "GET|POST|PUT|DELETE|PATCH"
    x = F.regexp_replace(F.regexp_replace(col(heading), rf"\(?HTTP\s+({methods})[^)]*\)?", ""), rf"\b({methods})\b", "")
    x = F.when(F.length(col(path)) > 0, F.replace(x, col(path), F.lit(""))).otherwise(x)
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "[_*`]", ""), r"\s+", " "))
    return F.nullif(F.regexp_replace(x, r"^[\- ()]+|[\- ()]+$", ""), F.lit(""))


_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"^\s*(#{1,6})\s+(.+?)\s*$")
_LINES = T.ArrayType(T.StructType([T.StructField("start_line", _I), T.StructField("end_line", _I)]))
_BLOCKS = T.StructType([T.StructField("headings", T.ArrayType(T.StructType([T.StructField("line", _I), T.StructField("level", _I), T.StructField("text", _S)]))), T.StructField("code_blocks", _LINES), T.StructField("table_blocks", _LINES)])


def block_ranges(md: str) -> dict:
    """Headings outside fences, and first and last lines (from 1) of fenced blocks and of tables of two lines or more. A fence that is not closed goes to the end."""
    lines = md.splitlines()
    kinds, fence, opened, code = [], None, 0, []
    for i, line in enumerate(lines, 1):
        mark = _FENCE.match(line)
        if fence is None and mark:
            fence, opened = mark[1], i
            kinds.append("code")
        elif fence is not None:
            kinds.append("code")
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                code.append((opened, i))
                fence = None
        else:
            kinds.append("table" if "|" in line and len(line.strip()) > 2 else "text")
    if fence is not None:
        code.append((opened, len(lines)))
    headings = [(i, len(m[1]), m[2].strip()) for i, (line, k) in enumerate(zip(lines, kinds, strict=True), 1) if k != "code" and (m := _HEADING.match(line))]
    tables, at = [], 0
    while at < len(kinds):
        end = at
        while end < len(kinds) and kinds[end] == "table":
            end += 1
        if end - at >= 2:
            tables.append((at + 1, end))
        at = max(end, at + 1)
    return {"headings": headings, "code_blocks": code, "table_blocks": tables}


@F.pandas_udf(_BLOCKS)
def blocks(md: pd.Series) -> pd.DataFrame:
    found = [block_ranges(t or "") for t in md]
    return pd.DataFrame({k: [f[k] for f in found] for k in ("headings", "code_blocks", "table_blocks")})


# --- excerpts --------------------------------------------------------------------------------------------------------------

#: Links that skip a page's navigation; under how many characters bullets, rows of links and switches of
#: language are a menu's; what share of a region's lines, of so many at least, makes it navigation.
SKIP_LINKS = ("skip to main content", "skip to content", "jump to content", "skip navigation", "jump to navigation")
BULLET, LINKS, SWITCH = 140, 200, 80
SHARE, LEAST_LINES = 0.4, 4

_SKIP = re.compile("|".join(SKIP_LINKS), re.I)
_MENU = re.compile(
    rf"""[*+-].{{0,{BULLET - 2}}}                              # an entry of a list
       | \[.*\]\(.*\)                                          # one link, or several, and nothing about them
       | (?=.{{0,{LINKS - 1}}}\Z) (?:.*?\[.*?\]\(.*?\)){{2}} .*   # a row with links
       | (?=.*\|) [^#|] .{{0,{SWITCH - 2}}}                     # a row of choices, but no table and no heading""",
    re.X,
)


class Layout:
    """Where a text's lines are, which of them look like a menu's and where links skip one: read once, asked for many places."""

    def __init__(self, md: str):
        lines = [m.span() for m in re.finditer(r"[^\n]*\S[^\n]*", md)]
        self.first, self.end = [a for a, _ in lines], [z for _, z in lines]
        self.menus = [0, *itertools.accumulate(_MENU.fullmatch(md[a:z].strip()) is not None for a, z in lines)]
        self.skips = [m.span() for m in _SKIP.finditer(md)]

    def is_navigation(self, at: int, around: int = 500) -> bool:
        """Whether the lines within so many characters of a place are navigation."""
        low, high = at - around, at + around
        if any(low <= a and z <= high for a, z in self.skips):
            return True
        i, j = bisect.bisect_right(self.end, low), bisect.bisect_left(self.first, high)
        return j - i >= LEAST_LINES and self.menus[j] - self.menus[i] > SHARE * (j - i)


def _forward(md: str, at: int) -> int:
    """The next end of a paragraph, sentence, line or word."""
    if at >= len(md):
        return len(md)
    near = md[at : at + 80]
    sentence = re.search(r"[.!?](?=[ \n\t]|\Z)" if at + 80 >= len(md) else r"[.!?](?=[ \n\t])", md[at : at + 81])
    for found in (near.find("\n\n"), sentence.end() if sentence and sentence.start() < 80 else -1, near.find("\n"), near[:50].find(" ")):
        if found >= 0:
            return at + found
    return at


def _backward(md: str, at: int) -> int:
    """The last line start before, else the last word start, within 50 characters."""
    low = max(0, at - 50)
    for sign in ("\n", " "):
        if (found := md.rfind(sign, low, at)) >= 0:
            return found + 1
    return at


def make_excerpt(md: str, needles: list[str], size: int = 400, most: int = 600) -> tuple[str, int, int]:
    """(excerpt, start, end) about the first needle that does not stand in navigation; without one what follows the navigation at the page's top. md[start:end] stripped and without zero-width signs is the excerpt."""
    pattern = re.compile("|".join(map(re.escape, needles)), re.I) if needles else None
    layout = Layout(md)
    hit = next((m.start() for m in pattern.finditer(md) if not layout.is_navigation(m.start())), None) if pattern else None
    if hit is None:
        head = re.search(r"\n##?\s+\w", md) if layout.is_navigation(0) else None
        start = head.start() + 1 if head else 0
        end = _forward(md, min(len(md), start + size))
    else:
        start = _backward(md, max(0, hit - size // 2)) if hit > size // 2 else 0
        end = _forward(md, min(len(md), max(0, hit - size // 2) + size))
        if end - start > most:
            end = _forward(md, start + most)
    return re.sub("[​‌‍﻿­]", "", md[start:end]).strip(), start, end


@F.pandas_udf(T.StructType([T.StructField("excerpt", _S), T.StructField("excerpt_start", _I), T.StructField("excerpt_end", _I)]))
def excerpt_about(md: pd.Series, needles: pd.Series) -> pd.DataFrame:
    rows = [make_excerpt(t or "", [n for n in ([] if ns is None else ns) if n]) for t, ns in zip(md, needles, strict=True)]
    return pd.DataFrame(rows, columns=["excerpt", "excerpt_start", "excerpt_end"])


@F.pandas_udf(T.BooleanType())
def is_navigation(md: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([Layout(t or "").is_navigation(int(a)) for t, a in zip(md, at, strict=True)])


# --- JSON ------------------------------------------------------------------------------------------------------------------


@F.pandas_udf(_S)
def canonical_json(c: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null for what is no JSON."""

    def one(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return c.map(one)


def json_hash(c: Column | str) -> Column:
    return F.sha2(canonical_json(col(c)), 256)


_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")


def api_tree(text: str | None) -> list[tuple[str, str]]:
    """(method, path) of a client library's description: {"urls": {"api": ...}, "api": {section: {method: paths}}}. Paths are lists, objects with costs, or deeper groups; a section's base is the path of its URL."""
    from urllib.parse import urlsplit

    try:
        given = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(given, dict) or not isinstance(given.get("api"), dict):
        return []
    urls = given["urls"].get("api") if isinstance(given.get("urls"), dict) else None
    base = lambda u: urlsplit(u).path.rstrip("/")
    bases = {k: base(u) for k, u in urls.items() if isinstance(u, str) and u.startswith("http")} if isinstance(urls, dict) else {}
    fallback = base(urls) if isinstance(urls, str) else next(iter(bases.values()), "")
    out: list[tuple[str, str]] = []
    joined = lambda prefix, key: f"{prefix}/{key}" if key else prefix
    todo = [(v, (k.upper() if k.upper() in _METHODS else "GET"), bases.get(s, fallback) if k.upper() in _METHODS else joined(bases.get(s, fallback), k)) for s, groups in given["api"].items() if isinstance(groups, dict) for k, v in groups.items()]
    todo.reverse()
    while todo:
        node, method, prefix = todo.pop()
        if isinstance(node, list):
            for item in node:
                if isinstance(item, str):
                    out.append((method, joined(prefix, item)))
                elif isinstance(item, dict) and (path := str(item.get("path", item.get("url", "")))):
                    out.append((method, path if path.startswith("/") else f"{prefix}/{path}"))
        elif isinstance(node, dict):
            below = []
            for key, v in node.items():
                if key.upper() in _METHODS:
                    below.append((v, key.upper(), prefix))
                elif isinstance(v, int | float):
                    out.append((method, joined(prefix, key)))
                else:
                    below.append((v, method, f"{prefix}/{key}"))
            todo += reversed(below)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("method", _S), T.StructField("path", _S)])))
def api_paths(c: pd.Series) -> pd.Series:
    return c.map(lambda t: [{"method": m, "path": p} for m, p in api_tree(t)])


@F.pandas_udf(T.ArrayType(_S))
def wayback_urls(c: pd.Series) -> pd.Series:
    """URLs of an archive's answer: a JSON list of lists whose first one names the columns."""

    def one(t):
        try:
            rows = json.loads(t)
            at = rows[0].index("original")
            return list(dict.fromkeys(r[at] for r in rows[1:] if len(r) > at and r[at]))
        except (TypeError, ValueError, IndexError, AttributeError, KeyError):
            return []

    return c.map(one)


# --- robots ----------------------------------------------------------------------------------------------------------------


def robots_rules(text: str | None, agent: str = "*") -> list[tuple[bool, str]]:
    """(allow, pattern) of the group for the agent, else for all (RFC 9309)."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names, in_rules = [], True
    for line in (text or "").splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = names if not in_rules else []
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
            in_rules = False
        elif key in ("allow", "disallow"):
            in_rules = True
            for n in names:
                if value:
                    groups[n].append((key == "allow", value))
    own = next((g for n, g in groups.items() if n != "*" and n in agent.lower()), None)
    return groups.get("*", []) if own is None else own


def robots_allows(text: str | None, path: str, agent: str = "*") -> bool:
    """The longest pattern that fits decides, of equals an allowing one; * is any run, $ the end."""
    best = (-1, True)
    for allow, pattern in robots_rules(text, agent):
        rule = "".join(".*" if c == "*" else re.escape(c) for c in pattern.removesuffix("$")) + (r"\Z" if pattern.endswith("$") else "")
        if re.match(rule, path, re.S):
            best = max(best, (len(pattern), allow))
    return best[1]


@F.pandas_udf(T.BooleanType())
def robots_allowed(status: pd.Series, robots: pd.Series, path: pd.Series) -> pd.Series:
    """2xx: by the rules; 4xx: everything; all else, also no answer: nothing."""
    def one(s, t, p):
        if pd.isna(s) or not 200 <= s < 500 or 300 <= s < 400:
            return False
        return s >= 400 or robots_allows(t, p or "/")

    return pd.Series([one(s, t, p) for s, t, p in zip(status, robots, path, strict=True)])
