"""Table-valued operators over documents: chunks, endpoints, dated entries, parameter tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pages as page_functions
from ..functions import text as tx
from ..functions import urls

MAX_TOKENS, HARD_CHARS, HARD_STEP, OVERLAP_TOKENS = 512, 1536, 1344, 64
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def windows(docs: DataFrame, size: int = HARD_CHARS, step: int = HARD_STEP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end, chunk): windows of characters; a text that fits is one. Without Python."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0))
    rows = docs.filter(n > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("doc_id", "chunk_index", start.alias("char_start"), F.least(start + size, F.length("__t")).alias("char_end"), F.substring("__t", (start + 1).cast("int"), F.lit(size)).alias("chunk"))


def tokens(s: str) -> int:
    return len(s) // 3


def _sections(md: str) -> list[tuple[int, int, str, int]]:
    """(start, end, heading, level) cut at headings outside fences."""
    out, at, start, head, level, fence = [], 0, 0, "", 0, None
    for line in md.splitlines(keepends=True):
        m = _FENCE.match(line)
        if m and (fence is None or m[1][0] == fence[0] and len(m[1]) >= len(fence)):
            fence = m[1] if fence is None else None
        elif fence is None and (h := _HEADING.match(line.rstrip("\r\n"))):
            if at > start:
                out.append((start, at, head, level))
            start, head, level = at, h[2], len(h[1])
        at += len(line)
    return out + [(start, at, head, level)] if at > start else out


def _blocks(md: str) -> list[tuple[int, int, bool]]:
    """(start, end, atomic): paragraphs; fences and tables are atomic."""
    out, at, start, fence, table = [], 0, 0, None, False
    for line in md.splitlines(keepends=True):
        m = _FENCE.match(line)
        row = line.lstrip().startswith("|")
        if fence is None and m:
            if at > start:
                out.append((start, at, table))
            start, fence = at, m[1]
        elif fence is not None:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                out.append((start, at + len(line), True))
                start, fence = at + len(line), None
        elif row != table and at > start:
            out.append((start, at, table))
            start = at
        elif not line.strip() and at + len(line) > start:
            out.append((start, at + len(line), table))
            start = at + len(line)
        if fence is None:
            table = row
        at += len(line)
    return out + [(start, at, fence is not None or table)] if at > start else out


def chunk_markdown(md: str) -> list[tuple[int, int, str, int]]:
    """(start, end, heading, level): a document of MAX_TOKENS is one chunk; else it is cut at headings, large sections at paragraphs; fences and tables stay whole; what is still too large is cut hard with overlap."""
    if not md.strip():
        return []
    if tokens(md) <= MAX_TOKENS:
        first = _sections(md)[0]
        return [(0, len(md), first[2], first[3])]
    out = []
    for a, b, head, level in _sections(md):
        if tokens(md[a:b]) <= MAX_TOKENS:
            out.append((a, b, head, level))
            continue
        start = end = a
        for x, y, atomic in _blocks(md[a:b]):
            x, y = a + x, a + y
            if end > start and tokens(md[start:y]) > MAX_TOKENS:
                out.append((start, end, head, level))
                back = max(start, end - OVERLAP_TOKENS * 3)
                start = back if tokens(md[back:y]) <= MAX_TOKENS else x
            if tokens(md[x:y]) > MAX_TOKENS and not atomic:
                for s in range(x, max(x + 1, y - (HARD_CHARS - HARD_STEP)), HARD_STEP):
                    out.append((s, min(s + HARD_CHARS, y), head, level))
                start = y
            end = y
        if end > start:
            out.append((start, end, head, level))
    return [c for c in out if md[c[0] : c[1]].strip()]


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end, heading, heading_level, chunk)."""
    kind = dict(docs.dtypes)[doc_id]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (whole.iloc[i : i + 256] for whole in frames for i in range(0, len(whole), 256)):  # chunks are copies of their text
            rows = [(d, i, a, b, h, lv, t[a:b]) for d, t in zip(f["d"], f["t"], strict=True) if t for i, (a, b, h, lv) in enumerate(chunk_markdown(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "char_start", "char_end", "heading", "heading_level", "chunk"])

    schema = f"doc_id {kind}, chunk_index int, char_start int, char_end int, heading string, heading_level int, chunk string"
    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInPandas(run, schema)


def with_context(chunk: Column, title: Column, heading: Column) -> Column:
    """"[title > heading]" on a line before the chunk; no heading where it is empty or the title."""
    title = F.coalesce(title, F.lit(""))
    head = F.when((heading == "") | heading.isNull() | (heading == title), title).when(title == "", heading).otherwise(F.concat(title, F.lit(" > "), heading))
    return F.when(head == "", chunk).otherwise(F.concat(F.lit("["), head, F.lit("]\n"), chunk))


# --- endpoints -------------------------------------------------------------------------------------------------------------

_METHODS = "GET|POST|PUT|DELETE|PATCH"
#: How pages name endpoints, in order of trust: a heading of method and path; a heading with a method whose path the code behind it has; code; a line of its own; a line in backticks.
PATTERNS = ("P4", "P3", "P2", "P1", "P5")
_HEADED = re.compile(rf"^#{{1,4}}\s+({_METHODS})\s+(/[^\s\]]+)")
_HEADED_METHOD = re.compile(rf"^#{{1,4}}\s+.+?\(HTTP\s+({_METHODS})")
_LINE = re.compile(rf"^\s*({_METHODS})\s+`?(/[^\s`?]+)`?")
_TICKED = re.compile(rf"^\s*`\s*({_METHODS})\s+(/[^\s`?]+)\s*`")
_BARE = re.compile(r"^\s*(/[^\s?]+)")
_INLINE = re.compile(r"[`\s](?:https?://[^/\s`]+)?(/[A-Za-z0-9_\-/{}:.]+)")
FIRST_LINES = 4  # of a code block


def named_endpoints(md: str | None) -> list[tuple[str, str, int, int]]:
    """(method, path, place of the pattern in PATTERNS, line) for each that a page names."""
    md = md or ""
    lines, code = md.splitlines(), page_functions.block_ranges(md)["code_blocks"]
    inside = {i for start, end in code for i in range(start, end + 1)}
    heads = lambda start, end: ((i, lines[i - 1]) for i in range(start + 1, min(end, start + FIRST_LINES + 1)) if i <= len(lines))
    out = []
    for i, line in enumerate(lines, 1):
        if m := _HEADED.match(line):
            out.append((m[1], m[2], 0, i))
        elif m := _HEADED_METHOD.match(line):
            block = next((b for b in code if b[0] > i), None)
            found = next(((n, x[x.lastindex]) for n, t in heads(*block) if (x := _LINE.match(t) or _BARE.match(t))), None) if block else None
            if not found:  # else what its own section names first
                below = next((k for k in range(i, len(lines)) if lines[k].startswith("#")), len(lines))
                found = next(((n + 1, x[1]) for n in range(i, below) if (x := _INLINE.search(" " + lines[n]))), None)
            if found:
                out.append((m[1], found[1], 1, found[0]))
        if i not in inside:
            out += [(x[1], x[2], rank, i) for rank, pattern in ((3, _LINE), (4, _TICKED)) if (x := pattern.match(line))]
    for block in code:
        if found := next(((n, x) for n, t in heads(*block) if (x := _LINE.match(t))), None):
            out.append((found[1][1], found[1][2], 2, found[0]))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("method", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("line", T.IntegerType())])))
def _named(md: pd.Series) -> pd.Series:
    return md.map(lambda t: [dict(zip(("method", "path", "rank", "line"), x, strict=True)) for x in named_endpoints(t)])


def endpoints(pages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, method, path, dedup_path, pattern, line): of each method and path of a page the first by pattern, then place."""
    rows = pages.select(F.col(doc_id).alias("doc_id"), F.inline(_named(F.col(text))))
    rows = rows.withColumns({"path": urls.normalized_api_path("path"), "dedup_path": urls.path_for_dedup("path")})
    first = F.min(F.struct("rank", "line", "path")).alias("f")
    pattern = F.element_at(F.array(*(F.lit(p) for p in PATTERNS)), F.col("f.rank") + 1)
    return rows.groupBy("doc_id", "method", "dedup_path").agg(first).select("doc_id", "method", F.col("f.path").alias("path"), "dedup_path", pattern.alias("pattern"), F.col("f.line").alias("line"))


def new_endpoints(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Each method and path once, from the least page; those that the store has are left out."""
    first = found.groupBy("method", "dedup_path").agg(F.min(F.struct("doc_id", "path")).alias("f")).select("method", "dedup_path", "f.doc_id", "f.path")
    return first.join(existing.select("method", "dedup_path"), ["method", "dedup_path"], "left_anti")


def record_id(source: Column, section: Column, protocol: Column, base_url: Column, version: Column, method: Column, path: Column) -> Column:
    """SHA-256 of the seven parts joined by bars; the last four are empty for other protocols than http."""
    http = lambda c: F.when(protocol == "http", F.coalesce(c, F.lit(""))).otherwise("")
    return F.sha2(F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(section, F.lit("")), F.coalesce(protocol, F.lit("")), http(base_url), http(version), F.upper(http(method)), http(path)), 256)


#: How pages state a rate limit, the first that is found.
_RATE = (
    r"(?i)Rate\s*Limit[:\s]+(\d+)\s*(?:requests?|times?|calls?)\s*(?:per|/)\s*(\d*)\s*(second|sec|s|minute|min|m|hour|h)",
    r"(?i)\bLimit[:\s]+(\d+)\s*(?:requests?)\s*(?:per|/)\s*(\d*)\s*(second|sec|s|minute|min|m)",
    r"(?i)(\d+)\s*(?:times?|次)\s*/\s*(\d*)\s*(s|秒|sec|min|m)",
)


def rate_limit(region: Column) -> tuple[Column, Column]:
    """(requests, period in seconds) by the first pattern that is found; null without one."""
    requests = period = None
    for p in _RATE:
        there = region.rlike(p)
        count = F.regexp_extract(region, p, 1).try_cast("bigint")
        n = F.coalesce(F.regexp_extract(region, p, 2).try_cast("bigint"), F.lit(1))
        unit = F.lower(F.regexp_extract(region, p, 3))
        seconds = n * F.when(unit.isin("m", "min", "minute"), 60).when(unit.isin("h", "hour"), 3600).otherwise(1)
        requests = F.when(there, count) if requests is None else requests.when(there, count)
        period = F.when(there, seconds) if period is None else period.when(there, seconds)
    return requests, period


def weight(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)\bweight\b\s*(?:is|=|:)?\s*(\d{1,9})", 1).try_cast("bigint")


def heading_before(md: Column, offset: Column) -> Column:
    """The last heading that starts at or before the offset (from 0)."""
    heads = F.regexp_extract_all(F.substring(md, F.lit(1), offset + 1), F.lit(r"(?m)^#{1,6}\s+(.*)$"), F.lit(1))
    return F.try_element_at(heads, F.lit(-1))


# --- dated entries ---------------------------------------------------------------------------------------------------------

_DATED = r"(?m)^(?=#{1,4}[^\n]*\d{4}-\d{2}-\d{2})"
_PROSE = rf"(?mi)^(?=#{{1,4}}[^\n]*(?:{'|'.join(tx.MONTHS)})\s+\d)"


def dated_entries(pages: DataFrame, url: str = "url", text: str = "md") -> DataFrame:
    """(url, seq, entry_date, entry, entry_hash): cut before headings with an ISO date, or, where there is none, with a date in prose. What stands before the first has no date of its own; a text without such headings is one entry, dated by the URL or the text."""
    c = F.col(text)
    pattern = F.when(F.size(F.split(c, _DATED)) > 1, 1).when(F.size(F.split(c, _PROSE)) > 1, 2).otherwise(0)
    parts = F.when(pattern == 1, F.split(c, _DATED)).when(pattern == 2, F.split(c, _PROSE)).otherwise(F.array(c))
    rows = pages.select(F.col(url).alias("url"), pattern.alias("pattern"), F.posexplode(F.filter(parts, lambda s: F.trim(s) != "")).alias("seq", "entry"))
    first = F.split(F.col("entry"), "\n")[0]
    own = tx.prose_date(F.when(first.rlike(r"^#{1,4}"), first))
    whole = F.coalesce(F.nullif(F.regexp_extract("url", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), tx.prose_date(F.substring("entry", 1, 500)))
    date = F.when(F.col("pattern") > 0, own).otherwise(whole)
    return rows.select("url", "seq", date.alias("entry_date"), F.trim("entry").alias("entry"), F.sha2(F.trim("entry"), 256).alias("entry_hash"))


# --- parameter tables ------------------------------------------------------------------------------------------------------

#: Header words of the columns.
_COLUMNS = {"name": ("parameter", "name", "field", "param", "key", "필드", "파라미터", "이름"), "type": ("type", "data type", "타입", "자료형"), "required": ("required", "mandatory", "필수"), "description": ("description", "desc", "comment", "note", "remark", "설명")}
_YES, _NO = ("yes", "true", "y", "required", "mandatory", "o", "필수"), ("no", "false", "n", "optional", "x", "선택")


#: Headings over parameters, and how far before and behind an endpoint's place they are looked for.
_PARAMETER_HEADING = re.compile(r"param|argument|request|field|quer|body|파라미터|요청", re.I)
BEFORE, BEHIND = 500, 3_000


def _lines(md: str) -> Iterator[tuple[int, str, int]]:
    """(place, line, level) of the lines outside fences; level: of a heading, else 0."""
    at, fence = 0, ""
    for line in md.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            fence = "" if mark and mark[1].startswith(fence) else fence
        elif mark:
            fence = mark[1]
        else:
            head = _HEADING.match(line)
            yield at, line, len(head[1]) if head else 0
        at += len(line) + 1


def _cells(line: str) -> list[str] | None:
    sign = "|" if "|" in line else "\t" if "\t" in line else None
    return [c.strip() for c in line.strip().strip("|").split(sign)] if sign else None


def _columns(header: list[str]) -> dict[str, int] | None:
    """The place of each column, of a header with a name column and another one."""
    where = {k: j for k, words in _COLUMNS.items() for j, h in reversed(list(enumerate(header))) if h.lower().strip("* ") in words}
    return where if "name" in where and len(where) > 1 else None


def tables(lines: Iterable[tuple[int, str, int]]) -> list[dict]:
    """Parameters of all tables with a name column, by an automaton over the lines: outside of a table, or in one with columns and the parents above.

    Dashes before a name make it a child of the last one that has fewer; a table under a heading or behind a line that names
    one parameter from above it, in code signs or as the heading's only word, has that parameter's fields.
    """
    out: list[dict] = []
    where, parents, number, owner = None, [], 0, None
    for _, line, level in lines:
        row = None if level else _cells(line)
        if row is None:
            where = None
            head = _HEADING.match(line)
            named = set(re.findall(r"`([^`]+)`", line)) | ({head[2].strip()} if head else set())
            known = [p["name"] for p in out if p["name"] in named]
            if known or level:
                owner = known[-1] if known else None
            continue
        if where is None:
            where = _columns(row)
            parents, number = [], number + (where is not None)
            continue
        if all(re.fullmatch(r":?-{2,}:?", c) for c in row if c) or where["name"] >= len(row) or not row[where["name"]]:
            continue
        raw = row[where["name"]].strip("`* ")
        depth = len(raw) - len(raw.lstrip(">-– "))
        name = raw.lstrip(">-– ").strip("`* ")
        parents = parents[:depth]
        cell = {k: row[j] for k, j in where.items() if j < len(row)}
        said = cell.get("required", "").lower().strip("* ")
        required = True if said in _YES else False if said in _NO else None
        out.append({"name": name, "type": cell.get("type"), "required": required, "description": cell.get("description"), "parent": parents[-1] if parents else owner, "table": number})
        parents.append(name)
    return out


def parameters(md: str | None) -> list[dict]:
    """Parameters of the first table with a name column."""
    return [p for p in tables(_lines(md or "")) if p["table"] == 1]


def parameters_near(md: str | None, at: int = 0) -> list[dict]:
    """Parameters of all tables in the section about parameters that is nearest behind an endpoint's place, or else before it: from its heading to the next one of its level or above. A parameter that tables repeat under one parent comes once."""
    lines = list(_lines(md or ""))
    heads = [(i, place, level) for i, (place, line, level) in enumerate(lines) if level and _PARAMETER_HEADING.search(line)]
    behind = [h for h in heads if at <= h[1] <= at + BEHIND]
    before = [h for h in heads if at - BEFORE <= h[1] < at]
    if not behind and not before:
        return []
    first, _, level = behind[0] if behind else before[-1]
    end = next((i for i in range(first + 1, len(lines)) if 0 < lines[i][2] <= level), len(lines))
    once = {(p["name"], p["parent"]): p for p in reversed(tables(lines[first:end]))}
    return list(reversed(once.values()))


# types as objects: the module is imported on workers, where no session can read a type's text
_TEXT = T.StringType()
_PARAMETER = T.ArrayType(T.StructType([T.StructField("name", _TEXT), T.StructField("type", _TEXT), T.StructField("required", T.BooleanType()), T.StructField("description", _TEXT), T.StructField("parent", _TEXT)]))
_REGION = T.ArrayType(T.StructType([*_PARAMETER.elementType.fields, T.StructField("table", T.IntegerType())]))


@F.pandas_udf(_PARAMETER)
def parameter_table(md: pd.Series) -> pd.Series:
    return md.map(parameters)


@F.pandas_udf(_REGION)
def region_parameters(md: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([parameters_near(t, int(a)) for t, a in zip(md, at, strict=True)])
