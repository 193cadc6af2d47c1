"""Lexical retrieval: postings as a table, BM25, boolean and phrase match, snippets.

A query set is a table (query_id, term): a stated set of questions' words, read by the driver. Texts are searched as they
are; `segments` keeps a stored index. Only top-k rows leave a partition.
BM25 (Robertson and Zaragoza): sum of idf * f (k1 + 1) / (f + k1 (1 - b + b len / avg)), idf = ln(1 + (N - df + .5) / (df + .5)).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

K1, B = 1.2, 0.75
TERMS_AT_ONCE = 2_000


def matched(docs: DataFrame, terms: list[str], fields: dict[str, tuple[Column, float]], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, len, hits): the weighted length and, of the terms alone, each token with its field's weight. One pass, no shuffle."""
    names = [f"__t{i}" for i in range(len(fields))]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *(F.coalesce(text.tokens(c), F.array().cast("array<string>")).alias(n) for n, (c, _) in zip(names, fields.values(), strict=True)))  # the tokens once a text; a null field has none
    weights = [float(w) for _, w in fields.values()]
    length = sum((F.size(n) * w for n, w in zip(names, weights, strict=True)), F.lit(0.0))
    own = lambda n, w: F.transform(F.filter(n, lambda t: t.isin(terms)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    return rows.select("doc_id", length.alias("len"), F.flatten(F.array(*(own(n, w) for n, w in zip(names, weights, strict=True)))).alias("hits"))


def bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, tuple[Column, float]], doc_id: str = "doc_id", k1: float = K1, b: float = B, only: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, n_terms); a higher score is better. only: the rows of docs that are to be scored, by the counts of all.

    The distinct terms of the stated queries, TERMS_AT_ONCE in a pass, are read by the driver with their document counts;
    texts are read twice a pass, once for the counts and once for the scores, and only tokens that a query has leave a text.
    """
    terms = sorted(r["term"] for r in queries.select("term").distinct().collect() if r["term"] is not None)  # the stated queries' own words
    out = None
    for i in range(0, max(len(terms), 1), TERMS_AT_ONCE):
        rows = matched(docs, terms[i : i + TERMS_AT_ONCE], fields, doc_id)
        seen = F.array_union(F.array(F.lit("")), F.array_distinct(F.transform("hits", lambda h: h["term"])))  # the empty term counts texts
        stats = {r["term"]: r for r in rows.select("len", F.explode(seen).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("total")).collect()}
        whole = stats.pop("", None)
        n, average = (whole["df"], whole["total"] / whole["df"] or 1.0) if whole else (0, 1.0)
        idf = [(t, math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))) for t, r in sorted(stats.items())]
        weighed = queries.select("query_id", "term").distinct().join(docs.sparkSession.createDataFrame(idf, "term string, idf double"), "term")
        asked = rows if only is None else matched(docs.filter(only), terms[i : i + TERMS_AT_ONCE], fields, doc_id)
        found = asked.filter(F.size("hits") > 0).select("doc_id", "len", F.explode("hits").alias("h")).select("doc_id", "len", "h.term", "h.w")
        hits = found.join(F.broadcast(weighed), "term").groupBy("query_id", "doc_id", "len", "term", "idf").agg(F.sum("w").alias("f"))  # the stated queries
        part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / average))
        scored = hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("n_terms"))
        out = scored if out is None else out.unionByName(scored)
    return out if len(terms) <= TERMS_AT_ONCE else out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.sum("n_terms").alias("n_terms"))


def matching(scored: DataFrame, queries: DataFrame, operator: str) -> DataFrame:
    """AND: all of a query's distinct terms occur; OR: any."""
    if operator == "OR":
        return scored
    n = queries.distinct().groupBy("query_id").agg(F.count("*").alias("__n"))
    return scored.join(n, "query_id").filter(F.col("n_terms") == F.col("__n")).drop("__n")


def with_or_fallback(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """AND where it finds anything, else OR."""
    strict = matching(scored, queries, "AND")
    return strict.unionByName(scored.join(strict.select("query_id").distinct(), "query_id", "left_anti"))


def top(scored: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """The k best of each query with their rank, from 1; ties by doc_id. Spark limits each partition before it shuffles."""
    w = Window.partitionBy("query_id").orderBy(order if order is not None else F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_with_fallback(scored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best that have all of a query's terms or, where there are none, the k best of all, from one pass over the scores: those with all terms rank first."""
    n = queries.distinct().groupBy("query_id").agg(F.count("*").alias("__n"))
    judged = scored.join(F.broadcast(n), "query_id").withColumn("__all", F.col("n_terms") == F.col("__n"))  # a row a stated query
    best = top(judged, k, F.struct((~F.col("__all")).alias("a"), (-F.col("score")).alias("s")))
    return best.withColumn("__any", F.max("__all").over(Window.partitionBy("query_id"))).filter(F.col("__all") | ~F.col("__any")).drop("__n", "__all", "__any")


def plain_tokens(c: Column) -> Column:
    """A question as the words that no match language can trip over: runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def phrase(docs: DataFrame, phrases: DataFrame, c: Column, doc_id: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, n): how often the terms of a phrase stand side by side. phrases: (query_id, term, pos), pos from 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(text.tokens(c)).alias("at", "term"))
    n = phrases.groupBy("query_id").agg(F.count("*").alias("__n"))
    starts = rows.join(phrases, "term").select("query_id", "doc_id", (F.col("at") - F.col("pos")).alias("start"), "pos")
    whole = starts.groupBy("query_id", "doc_id", "start").agg(F.count("*").alias("k")).join(n, "query_id").filter("k = __n")
    return whole.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))


def snippet(c: Column, terms: Column, size: int = 12) -> Column:
    """The first window of `size` words that holds most of the terms; terms in brackets, dots where text was cut."""
    ws = text.words(c)
    is_hit = lambda w: F.array_contains(terms, F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    flags = F.transform(ws, lambda w: F.when(is_hit(w), 1).otherwise(0))
    sums = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - size, F.lit(0))), lambda i: F.struct(F.aggregate(F.slice(flags, i + 1, F.lit(size)), F.lit(0), lambda a, x: a + x).alias("n"), (-i).alias("at")))
    start = -F.array_max(sums)["at"]
    shown = F.array_join(F.transform(F.slice(ws, start + 1, F.lit(size)), lambda w: F.when(is_hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return F.concat(F.when(start > 0, "...").otherwise(""), shown, F.when(start + size < F.size(ws), "...").otherwise(""))


#: Porter (1980), An algorithm for suffix stripping.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(word: str) -> str:
    """Porter's stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    shape = lambda w: "".join("v" if c in "aeiou" or (c == "y" and i and w[i - 1] not in "aeiou") else "c" for i, c in enumerate(w))
    measure = lambda w: shape(w).replace("vc", "|").count("|") if not w else len([1 for a, b in zip(shape(w), shape(w)[1:], strict=False) if a + b == "vc"])
    vowel = lambda w: "v" in shape(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c"
    short = lambda w: len(w) > 2 and shape(w)[-3:] == "cvc" and w[-1] not in "wxy"
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            if measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens):
    """Stems of arrays of tokens, each distinct token once a batch."""
    import pandas as pd

    known = {t: stem(t) for ts in tokens if ts is not None for t in set(ts)}
    return pd.Series([None if ts is None else [known[t] for t in ts] for ts in tokens])
