"""URL filter: rules by host and path, then a character language-model ratio. DataFrame and SQL functions only.

Two variable-order Markov models over the characters of host and path, one of accepted and one of rejected URLs, are
counted from labelled URLs: P_d(c | last d characters) = (n(context c) + K P_{d-1}(c)) / (n(context) + K), orders 0 to
ORDER, below order 0 uniform over 256 characters. A URL's score is the difference of its log-likelihoods (rejected less
accepted) divided by its length. It is blocked above a threshold calibrated on labelled URLs, three of sixteen by their
MD5, that models counted from all others score: half way between the 99th percentile of the accepted and the 1st of the
rejected, but not under 0. URLs are then judged by models counted from all labelled URLs. Where no held-out URL is rejected
all labelled ones calibrate; without rejected URLs nothing is blocked.

Labels: give a boolean Column; by default, as seeds, URLs whose host holds a junk term, set off by the host's ends, a dot, a
hyphen or a digit, are rejected, all others accepted. Each distinct host and path counts once, so one frequent URL has no
more weight.

A null URL or one without "://" has an empty host and path; those are never blocked by the models. Very long URLs are read
whole. Repeated rows each get a row, an empty table stays empty, extra columns pass through; those named like a result are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

ORDER = 4
K = 1.0

#: Terms of junk hosts, the seed labels.
JUNK_TERMS = ("adult", "bet", "bonus", "casino", "cheap", "escort", "gambling", "loan", "lottery", "pills", "poker", "porn", "replica", "sex", "spam", "viagra", "warez", "xxx")

#: verdict, host and path prefix, as the rule is written; the longest that fits wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits, and its verdict; both null where none fits. Of rules of equal length the first in order."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def is_junk(host: Column, terms=JUNK_TERMS) -> Column:
    return host.rlike(r"(^|[.\-0-9])(" + "|".join(terms) + r")($|[.\-0-9])")


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """Each character of `s` with up to `order` characters before it: the columns of texts, context, symbol."""
    padded = F.concat(F.lit("\x02" * order), F.col("s"))
    at = F.explode(F.sequence(F.lit(1), F.length("s")))
    rows = texts.filter("s <> ''").select(*texts.columns, at.alias("i"), padded.alias("__p"))
    return rows.select(*texts.columns, F.substring("__p", F.col("i"), F.lit(order)).alias("context"), F.substring("__p", F.col("i") + order, F.lit(1)).alias("symbol"))


def _ratios(grams: DataFrame, wanted: DataFrame, order: int, k: float) -> DataFrame:
    """(context, symbol, ratio): log P_rejected - log P_accepted. grams: (context, symbol, accepted, rejected) counts of the training characters; wanted: (context, symbol).

    From the empty context upwards: the probabilities after a context of d characters are joined with those after its last
    d - 1, so a key meets as many rows as there are characters, whatever the number of URLs.
    """
    p = lambda n, t, before: (F.coalesce(n, F.lit(0)) + k * before) / (F.coalesce(t, F.lit(0)) + k)
    even, below = F.lit(1 / 256), None
    for d in range(order + 1):
        key = F.substring("context", order - d + 1, d) if d else F.lit("")
        counts = grams.groupBy(key.alias("c"), F.col("symbol").alias("x")).agg(F.sum("accepted").alias("na"), F.sum("rejected").alias("nr"))
        level = wanted.select(key.alias("c"), F.col("symbol").alias("x")).distinct()
        if below is None:
            totals = counts.agg(F.sum("na").alias("ta"), F.sum("nr").alias("tr"))
            at = level.join(counts, ["c", "x"], "left").crossJoin(F.broadcast(totals))  # one row
            below = at.select("c", "x", p(F.col("na"), F.col("ta"), even).alias("pa"), p(F.col("nr"), F.col("tr"), even).alias("pr"))
            continue
        totals = counts.groupBy("c").agg(F.sum("na").alias("ta"), F.sum("nr").alias("tr"))
        at = level.join(counts, ["c", "x"], "left").join(totals, "c", "left").withColumn("u", F.substring("c", 2, d - 1) if d > 1 else F.lit(""))
        at = at.join(below.select(F.col("c").alias("u"), "x", F.col("pa").alias("ua"), F.col("pr").alias("ur")), ["u", "x"])
        below = at.select("c", "x", p(F.col("na"), F.col("ta"), F.col("ua")).alias("pa"), p(F.col("nr"), F.col("tr"), F.col("ur")).alias("pr"))
    return below.select(F.col("c").alias("context"), F.col("x").alias("symbol"), (F.ln("pr") - F.ln("pa")).alias("ratio"))


def score_strings(strings: DataFrame, labelled: DataFrame, order: int = ORDER, k: float = K) -> DataFrame:
    """(s, score) of the distinct strings. labelled: s, rejected boolean. The ratios are written once."""
    counted = _grams(labelled.select("s", "rejected").distinct(), order).groupBy("context", "symbol").agg(
        F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("rejected")
    )
    rows = _grams(strings.select("s").distinct(), order)
    wanted = written(rows.select("context", "symbol").distinct(), "wanted")
    ratios = written(_ratios(written(counted, "grams"), wanted, order, k), "ratios")
    return rows.join(ratios, ["context", "symbol"]).groupBy("s").agg((F.sum("ratio") / F.count("*")).alias("score"))


def for_calibration(s: Column) -> Column:
    """Three of sixteen strings, by their MD5: these are held out from the counts."""
    return F.substring(F.md5(s), 1, 1).isin("0", "1", "2")


def threshold(scores: DataFrame) -> DataFrame:
    """One row: threshold. scores: score, held_score (null where not held out), rejected; over held-out strings or, where none of these is rejected, over all. Percentiles over all rows; scores go by four decimals, so what each task keeps and sends is counts of a bounded number of values."""
    some = lambda c: [F.percentile(F.when(~F.col("rejected"), F.round(c, 4)), F.lit(0.99)), F.percentile(F.when(F.col("rejected"), F.round(c, 4)), F.lit(0.01))]
    (a, r), (all_a, all_r) = some("held_score"), some("score")
    q = scores.agg(a.alias("a"), r.alias("r"), all_a.alias("all_a"), all_r.alias("all_r"))
    middle = lambda a, r: F.greatest(F.lit(0.0), (F.coalesce(a, r) + F.col(r)) / 2)
    return q.select(F.when(F.col("r").isNotNull(), middle("a", "r")).when(F.col("all_r").isNotNull(), middle("all_a", "all_r")).alias("threshold"))


def held_out_quality(scores: DataFrame, limit: DataFrame) -> DataFrame:
    """One row over held-out strings: n, n_rejected, recall (of those rejected, blocked), precision (of those blocked, rejected)."""
    rows = scores.filter("held_score IS NOT NULL").crossJoin(F.broadcast(limit)).withColumn("b", F.coalesce(F.col("held_score") > F.col("threshold"), F.lit(False)))  # limit is one row
    both, blocked, bad = F.count_if(F.col("b") & F.col("rejected")), F.count_if("b"), F.count_if("rejected")
    return rows.agg(F.count("*").alias("n"), bad.alias("n_rejected"), (both / F.nullif(bad, F.lit(0))).alias("recall"), (both / F.nullif(blocked, F.lit(0))).alias("precision"))


def scored(rows: DataFrame, rejected: Column, order: int = ORDER, k: float = K) -> DataFrame:
    """(s, rejected, score, held_score), written: each distinct host and path once, rejected if any of its rows is; held_score: the held-out strings' score by models counted from the others. rows: host, path."""
    labelled = rows.select(F.concat("host", "path").alias("s"), F.coalesce(rejected, F.lit(False)).alias("rejected")).groupBy("s").agg(F.max("rejected").alias("rejected"))
    labelled = written(labelled, "labelled")
    held = labelled.filter(for_calibration(F.col("s")))
    apart = score_strings(held, labelled.filter(~for_calibration(F.col("s"))), order, k).withColumnRenamed("score", "held_score")
    return written(score_strings(labelled, labelled, order, k).join(labelled, "s").join(apart, "s", "left"), "scores")


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, terms=JUNK_TERMS, order: int = ORDER, rejected: Column | None = None) -> DataFrame:
    """Adds host, path, rule, score, verdict. rejected: labels, a boolean Column over host, path and the table's own columns; null counts as accepted; by default is_junk()."""
    rows = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__said": said, "__s": F.concat("host", "path")})
    scores = scored(rows, is_junk(F.col("host"), terms) if rejected is None else rejected, order)
    judged = scores.crossJoin(F.broadcast(threshold(scores))).select(F.col("s").alias("__s"), "score", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).alias("__junk"))  # the threshold is one row
    out = rows.join(judged, "__s", "left")
    verdict = F.coalesce("__said", F.when(F.coalesce("__junk", F.lit(False)), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("__s", "__said", "__junk")


def sql(rules=RULES, terms=JUNK_TERMS, order: int = ORDER, k: float = K) -> str:
    """The query in DuckDB's SQL, scores rounded as the query rounds them."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    fits = [f"((host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '{'/' + t.partition('/')[2]}'))" for _, t in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for f, (_, t) in zip(fits, ordered, strict=True)) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _) in zip(fits, ordered, strict=True)) + " END"
    pad = "chr(2)" + " || chr(2)" * (order - 1)

    def model(counts: str, name: str) -> str:
        steps, last = [], f"SELECT context, symbol, 1/256::DOUBLE AS pa, 1/256::DOUBLE AS pr FROM {counts} GROUP BY context, symbol"
        for d in range(order + 1):
            key = f"right(context, {d})" if d else "''"
            before = last if not d else f"SELECT * FROM {name}p{d - 1}"
            steps.append(f"{name}n{d} AS (SELECT {key} AS c, symbol AS x, sum(accepted) AS na, sum(rejected) AS nr FROM {counts} GROUP BY 1, 2), {name}t{d} AS (SELECT c AS t, sum(na) AS ta, sum(nr) AS tr FROM {name}n{d} GROUP BY 1)")
            steps.append(f"{name}p{d} AS (SELECT context, symbol, (coalesce(na, 0) + {k} * pa) / (coalesce(ta, 0) + {k}) AS pa, (coalesce(nr, 0) + {k} * pr) / (coalesce(tr, 0) + {k}) AS pr FROM ({before}) o LEFT JOIN {name}t{d} ON {key} = t LEFT JOIN {name}n{d} ON {key} = c AND symbol = x)")
        return ", ".join(steps)

    def quantiles(score: str, name: str) -> str:
        return f"quantile_cont(CASE WHEN NOT junk THEN round({score}, 4) END, 0.99) AS {name}a, quantile_cont(CASE WHEN junk THEN round({score}, 4) END, 0.01) AS {name}b"

    sums = lambda seen: f"sum(CASE WHEN {seen} AND NOT junk THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN {seen} AND junk THEN 1 ELSE 0 END) AS rejected"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l AS (SELECT host || path AS s, bool_or(regexp_matches(host, '(^|[.\\-0-9])({"|".join(terms)})($|[.\\-0-9])')) AS junk FROM h GROUP BY 1),
e AS (SELECT s, junk, {pad} || s AS p, unnest(range(1, length(s) + 1)) AS i FROM l),
r AS (SELECT s, junk, substr(md5(s), 1, 1) IN ('0', '1', '2') AS held, substr(p, i, {order}) AS context, substr(p, i + {order}, 1) AS symbol FROM e),
g AS (SELECT context, symbol, {sums("true")} FROM r GROUP BY 1, 2), h4 AS (SELECT context, symbol, {sums("NOT held")} FROM r GROUP BY 1, 2),
{model("g", "a")}, {model("h4", "h")},
z AS (SELECT s, any_value(junk) AS junk, sum(ln(a.pr) - ln(a.pa)) / count(*) AS score, CASE WHEN any_value(held) THEN sum(ln(b.pr) - ln(b.pa)) / count(*) END AS held_score FROM r JOIN ap{order} a USING (context, symbol) JOIN hp{order} b USING (context, symbol) GROUP BY s),
q AS (SELECT {quantiles("held_score", "")}, {quantiles("score", "all_")} FROM z),
m AS (SELECT CASE WHEN b IS NOT NULL THEN greatest(0.0, (coalesce(a, b) + b) / 2) WHEN all_b IS NOT NULL THEN greatest(0.0, (coalesce(all_a, all_b) + all_b) / 2) END AS threshold FROM q),
y AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said FROM h)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score > threshold THEN 'block' ELSE 'allow' END) AS verdict
FROM y LEFT JOIN z ON z.s = host || path CROSS JOIN m"""
