"""HTML and markdown functions: Column expressions where they say it, one standard-library parser behind a pandas UDF where not."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col


def title(html: Column | str) -> Column:
    """The title element's text, else the first h1's; trimmed, without tags; null if there is none."""
    c = col(html)
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""), r"\s+", " "))
    return F.coalesce(F.nullif(inner("title"), F.lit("")), F.nullif(inner("h1"), F.lit("")))


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def tag_count(html: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(html), F.lit(rf"(?i)<(?:{pattern})[\s>/]")).cast("bigint")


def meta_refresh(html: Column | str) -> Column:
    """The target of a meta refresh, null if there is none."""
    content = F.regexp_extract(col(html), r"""(?i)<meta[^>]*http-equiv=["']?refresh["']?[^>]*content=["']([^"']*)["']""", 1)
    return F.nullif(F.regexp_extract(content, r"(?i)url=\s*(\S+)", 1), F.lit(""))


def without_fences(markdown: Column | str) -> Column:
    """Fenced blocks, also one that is never closed, are cut out."""
    return F.regexp_replace(col(markdown), r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)", "")


def fence_count(markdown: Column | str) -> Column:
    return F.regexp_count(col(markdown), F.lit(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)")).cast("bigint")


def heading_count(markdown: Column | str) -> Column:
    return F.regexp_count(without_fences(markdown), F.lit(r"(?m)^#{1,6}\s+\S")).cast("bigint")


def table_count(markdown: Column | str) -> Column:
    """Tables: separator rows outside fences."""
    return F.regexp_count(without_fences(markdown), F.lit(r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")).cast("bigint")


def extraction_quality(html: Column | str, markdown: Column | str, words: Column) -> Column:
    """0.35 tables + 0.30 code + 0.15 headings + 0.20 words, each the share that came through."""
    share = lambda found, there: F.when(there == 0, 1.0).otherwise(F.least(found / there, F.lit(1.0)))
    tables = share(table_count(markdown), tag_count(html, "table"))
    code = share(fence_count(markdown), tag_count(html, "pre"))
    headings = share(heading_count(markdown), tag_count(html, "h[1-6]"))
    return 0.35 * tables + 0.30 * code + 0.15 * headings + 0.20 * F.least(words / 40.0, F.lit(1.0))


class _Markdown(HTMLParser):
    """HTML to plain markdown: headings, paragraphs, lists, code, links, tables."""

    _SKIP = {"script", "style", "noscript", "template", "svg", "head"}
    _BLOCK = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "header", "footer", "nav", "main", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.href: list[str] = []
        self.row: list[str] | None = None
        self.rows = 0

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP:
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.out.append("\0")
        elif tag in self._BLOCK:
            self.rows = 0
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self._SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("td", "th") and self.row is not None:
            at = len(self.out) - 1 - self.out[::-1].index("\0") if "\0" in self.out else None
            if at is not None:
                self.row.append(re.sub(r"\s+", " ", "".join(self.out[at + 1 :])).strip().replace("|", "\\|"))
                del self.out[at:]
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.out.append("\n| " + " | ".join(self.row) + " |")
                if self.rows == 0:
                    self.out.append("\n|" + " --- |" * len(self.row))
                self.rows += 1
            self.row = None
        elif tag in self._BLOCK or tag[:1] == "h":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = "".join(parser.out).replace("\0", "")
    text = "\n".join(line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown, na_action="ignore")


class _Structure(HTMLParser):
    """The texts of pre elements and the rows of tables, header cells apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pres: list[str] = []
        self.tables: list[list[tuple[bool, list[str]]]] = []
        self.pre: list[str] | None = None
        self.cell: list[str] | None = None
        self.row: list[str] | None = None
        self.header = False

    def handle_starttag(self, tag, attrs):
        if tag == "pre":
            self.pre = []
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row, self.header = [], False
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
            self.header |= tag == "th"

    def handle_endtag(self, tag):
        if tag == "pre" and self.pre is not None:
            self.pres.append("".join(self.pre).strip("\n"))
            self.pre = None
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(re.sub(r"\s+", " ", " ".join(self.cell)).strip().replace("|", "\\|"))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.tables[-1].append((self.header, self.row))
            self.row = None

    def handle_data(self, data):
        if self.pre is not None:
            self.pre.append(data)
        if self.cell is not None:
            self.cell.append(data)


def pipe_table(rows: list[tuple[bool, list[str]]]) -> str:
    """Rows of equal width; a header col_1, col_2, ... where the first row is none."""
    width = max(len(r) for _, r in rows)
    header = rows[0][1] if rows[0][0] else [f"col_{i + 1}" for i in range(width)]
    body = [r for _, r in (rows[1:] if rows[0][0] else rows)]
    shown = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([shown(header), "|" + " --- |" * width, *map(shown, body)])


def structure(html: str) -> str:
    """The page's code blocks and tables as markdown."""
    parser = _Structure()
    parser.feed(html)
    parser.close()
    code = [f"### Code Block {i}\n```text\n{t}\n```" for i, t in enumerate(parser.pres, 1) if t]
    return "\n\n".join(code + [pipe_table(t) for t in parser.tables if t])


_HAS_STRUCTURE = re.compile(r"<(?:pre|code|table)\b", re.I)
_SHOWS_STRUCTURE = re.compile(r"(?:```|~~~)|^\|.+\|", re.M)


def with_structure(md: str, html: str, least_words: int = 40) -> str:
    """The markdown, and where the page has code or tables that it does not show, or under 40 words, these behind it."""
    if not _HAS_STRUCTURE.search(html) or (len(md.split()) >= least_words and _SHOWS_STRUCTURE.search(md)):
        return md
    more = structure(html)
    return md if not more else (md.strip() + "\n\n---\n\n## Structured Fallback Extract\n\n" if md.strip() else "") + more


@F.pandas_udf(T.StringType())
def markdown_with_structure(md: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([m if h is None else with_structure(m or "", h) for m, h in zip(md, html, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def joined_links(base: pd.Series, hrefs: pd.Series) -> pd.Series:
    """Links against the page's own URL (RFC 3986); those that cannot be joined are left out."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([[u for u in (one(b, h) for h in ([] if hs is None else hs)) if u] for b, hs in zip(base, hrefs, strict=True)])


def links(html: Column | str, base: Column | str) -> Column:
    """The page's links as whole http(s) URLs that may be documents, each once, in order."""
    from . import urls

    found = F.array_distinct(F.transform(joined_links(col(base), hrefs(html)), lambda u: F.regexp_replace(u, "#.*$", "")))
    return F.filter(found, lambda u: u.rlike("(?i)^https?://") & urls.rejection(u).isNull())
