"""What kind of input a text is, and which sources it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source ("generic" and "http" stand for none) and pattern of error codes.
ERROR_CODES = (
    ("binance", r"-\d{4}\b"),
    ("okx", r"\b5\d{4}\b"),
    ("http", r"(?i)\bHTTP\s+[45]\d{2}\b"),
    ("http", r"(?i)\b[45]\d{2}\s+(?:Bad Request|Unauthorized|Forbidden|Not Found|Method Not Allowed|Conflict|Gone|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout)\b"),
    ("bybit", r"\b1[01]\d{3,4}\b"),
    ("kucoin", r"\b[24]00\d{3}\b"),
    ("bitget", r"\b4[0-9]\d{3}\b"),
    ("generic", r"\b\d{5,6}\b"),
)

#: Phrases of error messages.
ERROR_PHRASES = ("not authorized", "permission denied", "rate limit", "api key", "invalid signature", "unauthorized", "forbidden", "access denied", "insufficient", "enable .+ permission", "ip .+ not .+ whitelist")

#: Signs of program text.
CODE_SIGNS = (
    r"(?i)\bimport\s+\w+", r"\brequire\s*\(", r"(?i)\bcurl\s+", r"(?i)\bccxt\b", r"(?i)\bbinance[-_]connector\b", r"\bfetch\s*\(", r"\brequests\.\w+", r"(?i)\baxios\b", r"(?i)\baiohttp\b",
    r"(?m)^\s*const\s+\w+\s*=", r"(?m)^\s*let\s+\w+\s*=", r"(?m)^\s*var\s+\w+\s*=", r"(?m)^\s*def\s+\w+", r"(?m)^\s*async\s+def\s+\w+", r"(?i)\bwebsocket\.WebSocket", r"\bWebSocketApp\b", r"\bnew\s+\w+Client\b",
    r"\bhmac\.\w+", r"\bhashlib\.\w+", r"\.hexdigest\(\)", r"\bbase64\.\w+", r"\burllib\.parse\b", r"(?i)\bcrypto\.create\w+", r"(?m)^\s*\w+\s*=\s*\{['\"]", r"\.encode\s*\(['\"]",
    r"\.\b(?:create_order|cancel_order|fetch_balance|fetch_ticker|fetch_order_book|submitOrder|getOrderbook|getWalletBalance|placeOrder|cancelOrder)\s*\(", r"\b\w+Client(?:V\d+)?\.\w+\s*\(",
)

#: Paths with their method, form payloads, words that ask.
_PATH = r"(?i)(?:^|\s)((?:GET|POST|PUT|DELETE|PATCH)\s+)?(/[a-zA-Z0-9_\-/{}.:]+)"
_FORM = r"^[a-zA-Z_]\w*=[^&\s]+(&[a-zA-Z_]\w*=[^&\s]+)+$"
_ASKS = r"(?i)^(what|how|when|where|why|which|can|does|is|are)\b"
KINDS = ("error_message", "endpoint_path", "request_payload", "code_snippet", "question")


def scores(c: Column) -> dict[str, Column]:
    """A score for each kind. Codes within a JSON payload are not looked at."""
    t = F.trim(c)
    payload = F.coalesce(F.try_parse_json(t).isNotNull() & t.startswith("{"), F.lit(False))
    found = {i: F.regexp_count(t, F.lit(p)) for i, (_, p) in enumerate(ERROR_CODES)}
    total = sum(found.values(), F.lit(0))
    specific = sum((found[i] for i, (s, _) in enumerate(ERROR_CODES) if s not in ("generic", "http")), F.lit(0)) > 0
    generic = sum((found[i] for i, (s, _) in enumerate(ERROR_CODES) if s == "generic"), F.lit(0))
    error = 0.4 * total + F.when(t.rlike("(?i)" + "|".join(ERROR_PHRASES)), 0.3).otherwise(0.0)
    error = F.when(specific, F.greatest(error, F.lit(0.7))).otherwise(error)
    hits = sum((t.rlike(p).cast("int") for p in CODE_SIGNS), F.lit(0))
    error = F.when((hits > 0) & ~specific & (total > 0), F.greatest(error - 0.4 * generic, F.lit(0.0))).otherwise(error)
    path, method = F.regexp_extract(t, _PATH, 2), F.regexp_extract(t, _PATH, 1)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return {
        "error_message": F.when(payload, 0.0).otherwise(error),
        "endpoint_path": F.when(slashes >= 2, 0.6 + F.when(method != "", 0.2).otherwise(0.0)).otherwise(0.0),
        "request_payload": F.when(payload, 0.7).when(t.rlike(_FORM), 0.6).otherwise(0.0),
        "code_snippet": F.when(hits > 0, F.least(0.3 + 0.15 * hits, F.lit(0.9))).otherwise(0.0),
        "question": 0.2 + F.when(t.endswith("?") | t.rlike(_ASKS), 0.3).otherwise(0.0),
    }


def classified(c: Column) -> tuple[Column, Column]:
    """(kind, confidence): the highest score, of equals the first of KINDS. Null and empty texts are questions of confidence 0."""
    c = F.coalesce(c, F.lit(""))
    t = F.trim(c)
    ranked = F.array(*(F.struct(v.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, v) in enumerate(scores(c).items())))
    best = F.when(t == "", F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("order"), F.lit("question").alias("kind"))).otherwise(F.array_max(ranked))
    return best["kind"], F.round(F.least(F.greatest(best["score"], F.lit(0.0)), F.lit(1.0)), 2)


def detected_sources(asked: DataFrame, registry: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sources): sources whose id or name stands in the text as words, in the registry's order. The registry's names, some hundreds at most, are looked up among a text's runs of as many words; only names that it holds leave the text."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    names = registry.select("source", "ord", F.explode(F.array_distinct(F.array(words(F.col("source")), words(F.col("name"))))).alias("name_words")).filter(F.size("name_words") > 0)
    names = names.select("source", "ord", F.array_join("name_words", " ").alias("name"), F.size("name_words").alias("n"))
    by_size: dict[int, list[str]] = {}
    for r in names.select("n", "name").distinct().orderBy("n", "name").collect():  # of the registry
        by_size.setdefault(r["n"], []).append(r["name"])
    none = F.array().cast("array<string>")

    def held(ws: Column, n: int, wanted: list[str]) -> Column:
        runs = ws if n == 1 else F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(none)
        return F.array_intersect(runs, F.array(*map(F.lit, wanted)))

    # the words are a lambda's variable, so that a text is split once, not once a run
    spoken = F.transform(F.array(words(F.col(text))), lambda ws: F.concat(none, *(held(ws, n, wanted) for n, wanted in by_size.items())))
    found = asked.select(key, F.explode(F.get(spoken, F.lit(0))).alias("name")).join(F.broadcast(names.drop("n")), "name").select(key, "ord", "source").distinct()  # the registry
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("s")).select(key, F.transform("s", lambda x: x["source"]).alias("sources"))
