"""What a question wants: section, kind of answer, what program text is about. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Parts of URLs of test systems.
TEST_PARTS = ("/testnet/", "/sandbox/")

#: Questions about rate limits and about permissions.
RATE_LIMIT = r"(?i)\brate\s+limit\b|\bweight\b"
PERMISSIONS = r"(?i)\bpermissions?\b|\bapi\s+key\b|\bscopes?\b"

#: How a page says that a permission is required.
REQUIRES = (
    r"(?im)^\s*#+\s*permissions?\b|"
    r"\brequired\s+permissions?\b|"
    r"\bpermissions?\s*[:\-]\s*\w|"
    r"\bapi\s+key\s+permissions?\b|"
    r"\bpermission\s+required\b|"
    r"\benable\s+reading\b|"
    r"\benable\s+withdrawals?\b"
)

#: By source the words of a question and the section they stand for, the first that is found.
SECTION_WORDS = {
    "binance": (
        (r"\bportfolio\s+margin\b", "portfolio_margin"),
        (r"\bcopy\s+trading\b", "copy_trading"),
        (r"\bmargin\s+trading\b", "margin_trading"),
        (r"\bcoin[\-\s]?m\b|\bfutures\s+coinm\b", "futures_coinm"),
        (r"\busd[\-\s]?m\b|\busds\b|\bfutures\s+usdm\b", "futures_usdm"),
        (r"\bfutures\b", "futures_usdm"),
        (r"\boptions?\b", "options"),
        (r"\bmargin\b", "margin_trading"),
        (r"\bwebsocket\b|\bws\b|\bstream\b", "websocket"),
        (r"\bwallet\b", "wallet"),
        (r"\bspot\b", "spot"),
        (r"\bcopy\b", "copy_trading"),
    ),
    "kucoin": (
        (r"\bfutures?\b|\bperps?\b|\bperpetual\b", "futures"),
        (r"\bmargin\b", "margin"),
        (r"\bspot\b|\bmarket\s+data\b", "spot"),
    ),
    "kraken": (
        (r"\bfutures?\b|\bperps?\b|\bperpetual\b", "futures"),
        (r"\bspot\b", "spot"),
    ),
    "coinbase": (
        (r"\bprime\b", "prime"),
        (r"\bexchange\b", "exchange"),
        (r"\badvanced\s+trade\b", "advanced_trade"),
        (r"\bintx?\b|\binternational\b", "intx"),
    ),
    "bitget": (
        (r"\bcopy\s*trad\b", "copy_trading"),
        (r"\bmargin\b", "margin"),
        (r"\bearn\b|\bstaking\b", "earn"),
    ),
    "htx": (
        (r"\bcoin[\-\s]?margined?\b|\bcoin[\-\s]?m\b", "coin_margined_swap"),
        (r"\busdt?\s+swap\b|\blinear\b", "usdt_swap"),
        (r"\bfutures?\b|\bderivatives?\b|\bswap\b", "derivatives"),
        (r"\bspot\b", "spot"),
    ),
    "mexc": (
        (r"\bfutures?\b|\bcontract\b|\bperps?\b", "futures"),
        (r"\bspot\b", "spot"),
    ),
    "bitmart": (
        (r"\bfutures?\b|\bcontract\b|\bperps?\b", "futures"),
        (r"\bspot\b", "spot"),
    ),
    "okx": (
        (r"\bwebsocket\b|\bws\b|\bstream\b", "websocket"),
        (r"\brest\b|\bhttp\b|\bapi\b", "rest"),
    ),
}

#: What program text and its URLs say about the source, the first that is found.
LIBRARIES = (
    (r"(?i)\bokx\.\w+", "okx"),
    (r"(?i)\bbybit[-_]api\b", "bybit"),
    (r"(?i)\bbinance[-_]connector\b", "binance"),
    (r"(?i)RestClientV5", "bybit"),
    (r"(?i)KuCoinClient", "kucoin"),
    (r"(?i)new\s+Binance\b", "binance"),
)
API_HOSTS = (
    (r"(?i)api\.binance\.com", "binance"),
    (r"(?i)stream\.binance\.com", "binance"),
    (r"(?i)api\.bybit\.com", "bybit"),
    (r"(?i)api\.kucoin\.com", "kucoin"),
    (r"(?i)api\.gate\.io|api\.gateio\.ws", "gateio"),
    (r"(?i)api\.kraken\.com", "kraken"),
    (r"(?i)api\.bitfinex\.com", "bitfinex"),
    (r"(?i)www\.okx\.com", "okx"),
)
#: URLs of APIs in code.
_API_URL = r"(https?://(?:api\.\w+\.(?:com|io|ws)|www\.okx\.com|stream\.\w+\.com)/[^\s'\"`,\)\]]+)"

#: Methods of client libraries and what they are about.
METHOD_TOPICS = {
    "fetch_balance": "account balance",
    "fetch_ticker": "ticker market data",
    "fetch_tickers": "tickers market data",
    "fetch_order_book": "orderbook",
    "fetch_ohlcv": "klines candlestick",
    "create_order": "place order trading",
    "cancel_order": "cancel order",
    "fetch_orders": "orders list",
    "fetch_open_orders": "open orders",
    "fetch_my_trades": "trades history",
    "fetch_positions": "positions",
    "fetch_deposits": "deposit history",
    "fetch_withdrawals": "withdrawal history",
    "withdraw": "withdraw",
    "load_markets": "exchange info symbols",
    "getOrderbook": "orderbook",
    "getWalletBalance": "wallet balance",
    "submitOrder": "place order",
    "getTickers": "tickers",
    "getKline": "klines candlestick",
}


def is_test_url(url: Column | str) -> Column:
    low = F.lower(col(url))
    return low.contains(TEST_PARTS[0]) | low.contains(TEST_PARTS[1])


def shown_for(url: Column | str, question: Column | str) -> Column:
    """Pages of test systems are shown only for questions that name the testnet."""
    return ~is_test_url(url) | F.lower(col(question)).contains("testnet")


def wants_rate_limit(question: Column | str) -> Column:
    return col(question).rlike(RATE_LIMIT)


def wants_permissions(question: Column | str) -> Column:
    return col(question).rlike(PERMISSIONS)


def requires_permission(text: Column | str) -> Column:
    return col(text).rlike(REQUIRES)


def section(question: Column | str, source: Column, sections: Column) -> Column:
    """The section a question names: by the source's words, of those that the source has; else the first of its sections whose id, with blanks for underscores, stands in the question as a word. Null for sources of one section."""
    q = F.lower(col(question))
    by_words = F.lit(None).cast("string")
    for name, rules in SECTION_WORDS.items():
        own = F.lit(None).cast("string")
        for pattern, found in reversed(rules):
            has = F.lit(True) if name == "binance" else F.array_contains(sections, found)  # the first source's words hold whatever sections it lists
            own = F.when(q.rlike(pattern) & has, F.lit(found)).otherwise(own)
        by_words = F.when(source == name, own).otherwise(by_words)
    padded = F.concat(F.lit(" "), F.regexp_replace(q, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    named = F.filter(sections, lambda s: F.contains(padded, F.concat(F.lit(" "), s, F.lit(" "))) | F.contains(padded, F.concat(F.lit(" "), F.replace(s, F.lit("_"), F.lit(" ")), F.lit(" "))))
    return F.when((F.size(sections) > 1) | (source == "binance"), F.coalesce(by_words, F.try_element_at(named, F.lit(1))))


def _first(c: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(table):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def code_context(c: Column | str) -> Column:
    """A struct of source_hint, code_source (ccxt, library or url), api_path and the topics of the methods that the text names."""
    c = col(c)
    ccxt = F.nullif(F.lower(F.regexp_extract(c, r"\bccxt\.(\w+)\s*\(", 1)), F.lit(""))
    library, by_host = _first(c, LIBRARIES), _first(c, API_HOSTS)
    path = F.regexp_replace(F.regexp_extract(F.regexp_extract(c, _API_URL, 1), r"^https?://[^/]+([^?#]*)", 1), "/+$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"\{[^}]+\}", ""), "/+$", "")
    topics = F.array_compact(F.array(*(F.when(c.contains(m), F.struct(F.lit(m).alias("method"), F.lit(t).alias("topic"))) for m, t in METHOD_TOPICS.items())))
    return F.struct(
        F.coalesce(ccxt, library, by_host).alias("source_hint"), F.when(ccxt.isNotNull(), "ccxt").when(library.isNotNull(), "library").when(by_host.isNotNull(), "url").alias("code_source"),
        F.nullif(path, F.lit("")).alias("api_path"), topics.alias("methods"),
    )


def bm25_normalized(score: Column | str) -> Column:
    """|x| / (1 + |x|), so in [0, 1)."""
    x = F.abs(col(score))
    return x / (1 + x)


def guessed_source(url: Column | str, parts: list[tuple[str, str]], unknown: str = "unknown") -> Column:
    """The source of the first part of the list that the lower-cased URL holds."""
    low, out = F.lower(col(url)), F.lit(unknown)
    for part, source in reversed(parts):
        out = F.when(low.contains(part), source).otherwise(out)
    return out


def checked_source(name: str, aliases: dict[str, str] | None = None) -> str:
    """A source id from a user's filter: lower-cased, an alias by what it stands for; anything but a-z, digits and underscores is refused."""
    import re

    name = (aliases or {}).get(name.strip().lower(), name.strip().lower())
    if not re.fullmatch(r"[a-z0-9_]+", name):
        raise ValueError(f"EBADFILTER: {name!r} is no source id")
    return name


def rerank_policy(value: bool | str | None) -> str:
    """auto, always or never; True is always, False never, nothing auto."""
    if isinstance(value, bool):
        return "always" if value else "never"
    policy = (value or "auto").strip().lower()
    if policy not in ("auto", "always", "never"):
        raise ValueError(f"EBADPOLICY: {value!r}")
    return policy


def is_unsafe_host(host: Column | str) -> Column:
    """Names of this machine, and addresses that are not of the public Internet: private, loopback, link-local, shared, reserved and documentation ranges (RFC 6890), for IPv6 all outside 2000::/3 and its documentation range."""
    h = F.lower(F.trim(col(host)))
    v4 = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    n = lambda i: F.split(h, r"\.")[i].try_cast("int")
    a, b, c = n(0), n(1), n(2)
    special = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = h.contains(":")
    public = h.rlike(r"^\[?[23][0-9a-f]{3}:") & ~h.rlike(r"^\[?2001:0?db8:")
    return F.coalesce((h == "localhost") | h.endswith(".localhost") | F.when(v4, special).when(v6, ~public).otherwise(F.lit(False)), F.lit(False))
