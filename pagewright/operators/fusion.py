"""Fusion of ranked lists and decisions about reranking. Lists are (query_id, key, ...) rows; every window is over one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents

RRF_K = 60

#: By kind of input the weights of the lexical and the vector list, and alpha of the convex fusion.
RRF_WEIGHTS = {"question": (0.7, 1.3), "endpoint_path": (0.7, 1.3), "code_snippet": (0.7, 1.3), "error_message": (1.3, 0.7), "request_payload": (1.3, 0.7)}


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, key, score): sum of weight / (k + rank). lists: query_id, list_id, key, rank, weight; a key that a list repeats counts again; null and empty keys do not."""
    return lists.filter(F.col("key").isNotNull() & (F.col("key").cast("string") != "")).groupBy("query_id", "key").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def minmax(c: str, span: float = 1e-9) -> Column:
    w = Window.partitionBy("query_id")
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(F.col(c).isNull(), 0.0).when(high - low < span, 1.0).otherwise((F.col(c) - low) / (high - low))


def convex(lexical: DataFrame, semantic: DataFrame, alpha: float | Column) -> DataFrame:
    """(query_id, key, score, in_both): alpha * minmax(lexical) + (1 - alpha) * minmax(semantic), a missing side 0."""
    a = lexical.withColumn("l", minmax("score")).select("query_id", "key", "l")
    b = semantic.withColumn("s", minmax("score")).select("query_id", "key", "s")
    both = a.join(b, ["query_id", "key"], "full")
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    score = alpha * F.coalesce("l", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return both.select("query_id", "key", score.alias("score"), (F.col("l").isNotNull() & F.col("s").isNotNull()).alias("in_both"))


def strong_signal(scored: DataFrame, top: float = 0.7, gap: float = 0.3) -> DataFrame:
    """(query_id, strong): the best score is high and far before the second; a single one needs no gap."""
    best = scored.groupBy("query_id").agg(F.max("score").alias("a"), F.max_by("score", F.struct("score", "key")).alias("__"), F.count("*").alias("n"))
    second = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))).filter("r = 2").select("query_id", F.col("score").alias("b"))
    joined = best.join(second, "query_id", "left")
    return joined.select("query_id", ((F.col("a") >= top) & ((F.col("n") == 1) | (F.col("a") - F.col("b") >= gap))).alias("strong"))


def auto_rerank(scored: DataFrame, limit: int, delta: float = 0.006, spread: float = 0.02) -> DataFrame:
    """(query_id, rerank, reason): few candidates need none; close scores among the first five do."""
    enough = max(2, min(6, 2 * limit))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    ranked = scored.withColumn("r", F.row_number().over(w))
    at = lambda i: F.max(F.when(F.col("r") == i, F.col("score")))
    sums = ranked.groupBy("query_id").agg(F.count("*").alias("n"), at(1).alias("a"), at(2).alias("b"), F.min(F.when(F.col("r") <= 5, F.col("score"))).alias("z"))
    close = (F.round(F.col("a") - F.col("b"), 12) <= delta) | (F.round(F.col("a") - F.col("z"), 12) <= spread)
    reason = F.when(F.col("n") < enough, "few_candidates").when(close, "ambiguous").otherwise("confident")
    return sums.select("query_id", (reason == "ambiguous").alias("rerank"), reason.alias("reason"))


def position_blend(ranked: DataFrame, code_like: bool = False) -> DataFrame:
    """(query_id, key, score): the retrieval score, by the maximum, with the rerank score, by the sigmoid; the weights change with the rank. ranked: query_id, key, rank, score, rerank."""
    weights = (0.55, 0.40, 0.30) if code_like else (0.75, 0.60, 0.40)
    top = F.max("score").over(Window.partitionBy("query_id"))
    norm = F.when(top > 0, F.col("score") / top).otherwise(0.0)
    w = F.when(F.col("rank") <= 3, weights[0]).when(F.col("rank") <= 10, weights[1]).otherwise(weights[2])
    sigmoid = 1 / (1 + F.exp(-F.col("rerank")))
    return ranked.select("query_id", "key", F.when(F.col("rerank").isNull(), norm).otherwise(w * norm + (1 - w) * sigmoid).alias("score"))


def reranked(rows: DataFrame, scores: DataFrame | None, k: int, policy: str | bool | None = None, code_like: bool = False) -> DataFrame:
    """rows (query_id, key, score) with the model's scores (query_id, key, rerank) blended in where the policy says so, and whether they were."""
    policy = intents.rerank_policy(policy)
    if scores is None or policy == "never":
        return rows.withColumn("reranked", F.lit(False))
    wants = auto_rerank(rows, k).select("query_id", "rerank") if policy == "auto" else rows.select("query_id").distinct().withColumn("rerank", F.lit(True))
    marked = rows.join(wants.withColumnRenamed("rerank", "__wants"), "query_id")
    ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))).join(scores.select("query_id", "key", "rerank"), ["query_id", "key"], "left")
    blended = position_blend(ranked.select("query_id", "key", "rank", "score", "rerank"), code_like).withColumnRenamed("score", "__blend")
    out = marked.join(blended, ["query_id", "key"])
    return out.select("query_id", "key", F.when(F.col("__wants"), F.col("__blend")).otherwise(F.col("score")).alias("score"), F.col("__wants").alias("reranked"))


def best_per(ranked: DataFrame, group: str) -> DataFrame:
    """Of each query and group the row of the best rank, as a minimum."""
    rest = [c for c in ranked.columns if c not in ("query_id", group, "rank")]
    return ranked.groupBy("query_id", group).agg(F.min(F.struct("rank", *rest)).alias("__b")).select("query_id", group, "__b.rank", *(f"__b.{c}" for c in rest))


#: Overview pages and the broad questions that want them; deprecated pages.
OVERVIEW = r"(?i)/(intro(?:duction)?|overview|general[_-]?info|getting[_-]?started|quick[_-]?start|authentication|request[_-]?security|rate[_-]?limit|api[_-]?info|rest-api(?:/|$))(?:[^/]*)?$"
BROAD = (
    r"(?i)\bhow\s+(?:to|do|does|can|many)\b|\bwhat\s+(?:is|are|does)\b|\brate\s+limit|\bpermission|\bauthenticat|\bintro(?:duction)?\b|"
    r"\boverview\b|\bquickstart\b|\bgetting\s+started\b|\bendpoints?\b|\bbest\s+practice|\bsandbox\b|\bAPI\s+(?:docs?|documentation|reference)\b|\bAPI\s*$"
)
DEPRECATED = r"(?i)/(abandoned[_-]?endpoints?|deprecated|legacy[_-]?api|obsolete|old[_-]?api)/"


def page_type_boost(score: Column, url: Column, question: Column, factor: float = 1.4) -> Column:
    return F.when(url.rlike(OVERVIEW) & question.rlike(BROAD), score * factor).otherwise(score)


def section_boost(score: Column, url: Column, prefix: Column, factor: float = 1.3) -> Column:
    return F.when(url.startswith(prefix), score * factor).otherwise(score)


def deprecated_demotion(score: Column, url: Column, factor: float = 0.5) -> Column:
    """An option; no query uses it by default."""
    return F.when(url.rlike(DEPRECATED), score * factor).otherwise(score)
