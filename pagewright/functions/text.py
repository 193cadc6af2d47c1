"""Text functions as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no search meaning.
STOPWORDS = (
    "the", "and", "for", "what", "how", "does", "this", "that", "with", "from",
    "are", "can", "api", "is", "it", "of", "to", "in", "on", "by", "an", "a",
)

#: Words of program text that carry no search meaning.
CODE_STOPWORDS = (
    "import", "from", "print", "def", "class", "return", "self", "none", "true",
    "false", "lambda", "pass", "break", "continue", "yield", "async", "await",
    "const", "let", "var", "function", "require", "module", "exports", "new",
    "console", "log", "then", "catch", "finally", "undefined", "null",
    "ccxt", "exchange", "client", "result", "response", "error", "data",
    "params", "options", "config", "key", "secret", "apikey", "apisecret",
    "str", "int", "float", "dict", "list", "set", "type", "encode", "decode",
)

#: Terms also searched for.
SYNONYMS = {
    "ws": ["websocket"],
    "websocket": ["ws", "wss"],
    "wss": ["websocket", "ws"],
    "auth": ["authentication", "authorization"],
    "authentication": ["auth"],
    "authorization": ["auth"],
    "perps": ["perpetual", "perpetuals"],
    "perpetual": ["perps"],
    "ohlc": ["candlestick", "kline", "candle"],
    "candlestick": ["ohlc", "kline"],
    "kline": ["ohlc", "candlestick"],
    "candle": ["ohlc", "candlestick", "kline"],
    "orderbook": ["order-book", "depth"],
    "order-book": ["orderbook", "depth"],
    "depth": ["orderbook", "order-book"],
    "subaccount": ["sub-account"],
    "sub-account": ["subaccount"],
    "rest": ["http"],
    "withdraw": ["withdrawal"],
    "withdrawal": ["withdraw"],
    "deposit": ["deposits"],
    "balance": ["balances"],
    "ticker": ["tickers"],
    "symbol": ["symbols"],
    "trade": ["trades", "trading"],
    "trading": ["trade", "trades"],
    "leverage": ["margin"],
    "margin": ["leverage"],
    "pnl": ["profit", "unrealized"],
    "profit": ["pnl"],
    "funding": ["funding-rate"],
    "funding-rate": ["funding"],
    "fee": ["commission"],
    "commission": ["fee"],
    "transfer": ["internal-transfer"],
    "position": ["positions"],
    "positions": ["position"],
    "listen-key": ["user-data-stream"],
    "user-data-stream": ["listen-key"],
    "market": ["exchange-info", "symbols"],
    "account": ["wallet"],
    "wallet": ["account"],
    "order": ["orders"],
    "orders": ["order"],
}

MAX_SYNONYMS = 3
MAX_TERMS = 8
MATCH_WORDS = ("OR", "AND", "NOT", "NEAR")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(col(c), r"\s+"), lambda t: t != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("bigint")


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(col(c)) / 3).cast("bigint")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_terms(c: Column | str, extra_stopwords: tuple[str, ...] = (), synonyms: bool = True) -> Column:
    """Words of three or more characters that are no stopwords, hyphens kept, with up to MAX_SYNONYMS synonyms behind."""
    stop = F.array(*(F.lit(w) for w in (*STOPWORDS, *extra_stopwords)))
    kept = F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s\-]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return expand_synonyms(kept) if synonyms else kept


def expand_synonyms(terms: Column, most: int = MAX_SYNONYMS) -> Column:
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    found = F.flatten(F.filter(F.transform(terms, lambda t: table[t]), lambda a: a.isNotNull()))
    return F.concat(terms, F.slice(F.array_distinct(F.filter(found, lambda s: ~F.array_contains(terms, s))), 1, most))


def quoted_for_match(c: Column | str) -> Column:
    """Words with signs that the match language knows are put into double quotes, inner ones doubled."""
    special = r"""[-:"'/{}()*?=&+#@!<>;]"""
    quoted = lambda t: F.when(~t.rlike(special) | (t.startswith('"') & t.endswith('"')), t).otherwise(F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.array_join(F.transform(words(c), quoted), " ")


def match_query(terms: Column, operator: str = "AND", most: int = MAX_TERMS) -> Column:
    """The first terms, quoted and joined by AND or OR, without the match language's own words."""
    own = F.array(*(F.lit(w) for w in MATCH_WORDS))
    clean = F.filter(F.slice(terms, 1, most), lambda t: (t != "") & ~F.array_contains(own, F.upper(t)))
    return F.array_join(F.transform(clean, quoted_for_match), f" {operator.upper()} ")


def normalized_question(c: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def normalized_markdown(c: Column | str) -> Column:
    """One line end, [code] blocks as fences, no blanks at line ends, no more than two line ends on end."""
    x = F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = F.regexp_replace(x, r"(?is)\[code\]\n*(.*?)\n*\[/code\]", "```\n$1\n```")
    x = F.regexp_replace(x, r"[ \t]+(?=\n)|[ \t]+\z", "")
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


# --- dates ---------------------------------------------------------------------------------------------------------------

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(" + "|".join(m.capitalize() for m in MONTHS) + ")"


def prose_date(c: Column | str) -> Column:
    """The first ISO date; else the first "Month D, YYYY" of 2000 to 2099; else "Month YYYY", the first of the month."""
    c = col(c)
    number = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))))
    iso = F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    full, short = rf"(?i){_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", rf"(?i){_MONTH}\s+(\d{{4}})"
    part = lambda pattern, i: F.expr("null") if i is None else F.regexp_extract(c, pattern, i)
    day, year = part(full, 2).try_cast("int"), part(full, 3).try_cast("int")
    whole = F.when(day.between(1, 31) & year.between(2000, 2099), F.format_string("%04d-%02d-%02d", year, number[F.lower(part(full, 1))], day))
    y = part(short, 2).try_cast("int")
    month = F.when(y.between(2000, 2099), F.format_string("%04d-%02d-01", y, number[F.lower(part(short, 1))]))
    return F.coalesce(iso, whole, month)


# --- impact of a change ---------------------------------------------------------------------------------------------------

#: Impact class, severity, pattern; in order.
IMPACTS = (
    ("endpoint_removed", "err", r"(?:endpoint|api|path|route).*?(?:removed|retired|deleted|sunset|will\s+be\s+removed|will\s+be\s+retired)"),
    ("breaking_change", "err", r"(?:breaking\s+change|incompatible|no\s+longer\s+(?:support|accept)|must\s+(?:update|migrate))"),
    ("parameter_removed", "err", r"(?:parameter|field|property|column).*?(?:removed|deleted|will\s+be\s+removed)"),
    ("endpoint_deprecated", "warn", r"(?:endpoint|api|path|route).*?deprecated|deprecated.*?(?:endpoint|api|path)"),
    ("rate_limit_change", "warn", r"rate\s+limit|weight.*?(?:changed|updated|increased|decreased|adjusted)"),
    ("parameter_change", "warn", r"(?:parameter|field).*?(?:renamed|changed|updated|now\s+required|type\s+changed|mandatory)"),
    ("endpoint_added", "info", r"(?:new|added)\s+(?:an?\s+)?(?:endpoint|api|path|route)|(?:new|added)\s+(?:an?\s+)?(?:GET|POST|PUT|DELETE|PATCH)\s+/"),
    ("field_added", "info", r"(?:new|added)\s+(?:an?\s+)?(?:field|parameter|response\s+field|column|attribute)"),
)


def impact_classes(c: Column | str) -> Column:
    """The classes whose pattern is found, in order; else informational."""
    found = F.array_compact(F.array(*(F.when(col(c).rlike("(?i)" + p), F.lit(name)) for name, _, p in IMPACTS)))
    return F.when(F.size(found) == 0, F.array(F.lit("informational"))).otherwise(found)


def max_severity(c: Column | str) -> Column:
    rank = F.greatest(F.lit(1), *(F.when(col(c).rlike("(?i)" + p), F.lit({"err": 3, "warn": 2, "info": 1}[s])).otherwise(0) for _, s, p in IMPACTS))
    return F.element_at(F.array(F.lit("info"), F.lit("warn"), F.lit("err")), rank)


def affected_paths(c: Column | str) -> Column:
    """"METHOD path" for each named with its method, then bare API paths that were not; each once."""
    c = col(c)
    method, with_method = r"(?i)(?:GET|POST|PUT|DELETE|PATCH)\s+/[a-zA-Z0-9/_{}.\-:]+", r"(?i)^([A-Z]+)\s+"
    trim = lambda p: F.regexp_replace(p, r"[.,;:)]+$", "")
    named = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(method), F.lit(0)), lambda m: F.concat(F.upper(F.regexp_extract(m, with_method, 1)), F.lit(" "), trim(F.regexp_replace(m, with_method, "")))))
    #: Fixed value: paths that are named without a method.
    bare = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\w)(/(?:api|sapi|fapi|dapi|v[1-5])/[a-zA-Z0-9/_{}.\-]+)"), F.lit(1)), trim))
    return F.concat(named, F.filter(bare, lambda p: ~F.array_contains(named, F.concat(F.lit("GET "), p)) & ~F.array_contains(named, F.concat(F.lit("POST "), p))))


# --- quality of content ----------------------------------------------------------------------------------------------------


def stripped_lines(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def nav_line_ratio(c: Column | str) -> Column:
    """The share of lines that look like navigation; 0 under four lines."""
    lines = stripped_lines(c)
    bullet = lambda s: s.rlike(r"^[*\-+]") & (F.length(s) < 100)
    link = lambda s: s.startswith("[") & s.contains("](") & s.endswith(")")
    short = lambda s: (F.length(s) < 30) & ~s.rlike(r"[.,:;!?|#]")
    nav = F.filter(lines, lambda s: bullet(s) | link(s) | short(s))
    return F.when(F.size(lines) < 4, F.lit(0.0)).otherwise(F.size(nav) / F.size(lines))


def content_flags(markdown: Column | str, html: Column | str, count: Column) -> Column:
    """empty or thin, nav_chrome, spa_shell."""
    lines = F.transform(F.split(col(markdown), "\n"), lambda s: F.trim(s))
    nav = F.size(F.filter(lines, lambda s: (F.length(s) < 50) & s.rlike(r"^[*\-\[]")))
    prose = F.size(F.filter(lines, lambda s: F.length(s) > 60))
    #: Fixed value: pages that a browser has to build.
    shell = r"(?is)<div\s+id=[\"'](?:app|root|__next|__nuxt|gatsby-focus-wrapper)[\"']>\s*</div>|<noscript>.*?enable\s+javascript.*?</noscript>|window\.__(?:NEXT_DATA|NUXT|INITIAL_STATE)__\s*="
    return F.array_compact(F.array(
        F.when(count == 0, F.lit("empty")).when(count < 50, F.lit("thin")),
        F.when((nav > 5) & (nav > prose * 2) & (count < 200), F.lit("nav_chrome")),
        F.when(F.coalesce(col(html).rlike(shell), F.lit(False)) & (count < 50), F.lit("spa_shell")),
    ))


def chunk_class(c: Column | str) -> Column:
    """code_heavy, table_heavy, url_heavy, cjk_text or prose, the first that holds."""
    c = col(c)
    lines = F.split(F.trim(c), "\n")
    n = F.size(lines)
    code = F.size(F.filter(lines, lambda s: s.startswith("  ") | s.startswith("\t") | s.startswith("```")))
    table = F.size(F.filter(lines, lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2))
    cjk = F.length(c) - F.length(F.regexp_replace(c, r"[\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{3040}-\x{30ff}]", ""))
    return (
        F.when(code / n > 0.5, "code_heavy").when(table / n > 0.3, "table_heavy")
        .when(F.regexp_count(c, F.lit("https?://")) > 3, "url_heavy").when(cjk > F.length(c) * 0.1, "cjk_text").otherwise("prose")
    )
