"""Hybrid search: a lexical and a vector list of each question, one result.

Lists come longer than wanted (OVER_FETCH times k), as a filter on sources and the union of a page's chunks shorten them.
Where the lexical list's first score is clearly ahead, the vector list is left out. Both lists are fused by the question's
kind of input, by reciprocal ranks or a convex sum of scores. Scores of a reranking model, where they are given, are blended
in for the questions whose fused scores are close, or for all or none by the policy. Everything is joined by question: the
questions are a stated set, the lists have OVER_FETCH * k rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents
from . import answer, fusion

OVER_FETCH = 3


def of_source(found: DataFrame, questions: DataFrame, pages: DataFrame) -> DataFrame:
    """found (query_id, key, score) with page, without keys of another source than the question's, if it has one. questions: query_id, source; pages: key, source, page."""
    wanted = questions.select("query_id", F.col("source").alias("__wanted"))
    own = found.join(pages.select("key", F.col("source").alias("__source"), "page"), "key").join(F.broadcast(wanted), "query_id")  # the stated questions
    return own.filter(F.col("__wanted").isNull() | (F.col("__wanted") == F.col("__source"))).drop("__wanted", "__source")


def listed(found: DataFrame, n: int, by_page: bool) -> DataFrame:
    """The n best of each question with their rank; by_page: of a page's keys the best one only, then ranked anew."""
    order = lambda *keys: Window.partitionBy("query_id", *keys).orderBy(F.col("score").desc(), "key")
    if by_page:
        found = found.withColumn("__r", F.row_number().over(order("page"))).filter("__r = 1").drop("__r")
    return found.withColumn("rank", F.row_number().over(order())).filter(F.col("rank") <= n)


def search(
    questions: DataFrame, lexical: DataFrame, semantic: DataFrame, pages: DataFrame, k: int, mode: str = "rrf", rerank: DataFrame | None = None, policy: str | bool | None = None,
    strong: tuple[float, float] = (0.7, 0.3), normalized: Column | None = None,
) -> DataFrame:
    """(query_id, key, score, rank, used_vectors, reranked): the k best keys of each question, a page once.

    questions: query_id, kind, source (null: any); lexical, semantic: query_id, key, score, higher is better; pages: key,
    source, page; rerank: query_id, key, rerank. normalized: the lexical score in [0, 1] that strong's (first score, lead)
    is held against, by default score / (1 + score).
    """
    lex = listed(of_source(lexical.select("query_id", "key", "score"), questions, pages), OVER_FETCH * k, True)
    sem = listed(of_source(semantic.select("query_id", "key", "score"), questions, pages), OVER_FETCH * k, True)
    norm = normalized if normalized is not None else intents.bm25_normalized("score")
    sure = fusion.strong_signal(lex.select("query_id", "key", norm.alias("score")), *strong).filter("strong").select("query_id")
    sem = sem.join(sure, "query_id", "left_anti")
    # a page that both lists have under different keys goes by the lexical key
    names = lex.select("query_id", "page", F.col("key").alias("__key"))
    sem = sem.join(names, ["query_id", "page"], "left").withColumn("key", F.coalesce("__key", "key"))
    fused = answer.fused(lex.select("query_id", "key", "score", "rank"), sem.select("query_id", "key", "score", "rank"), questions, mode)
    best = fusion.reranked(fused.select("query_id", "key", F.round("score", 9).alias("score")), rerank, k, policy)
    flag = best.join(sure.withColumn("__sure", F.lit(True)), "query_id", "left").withColumn("used_vectors", F.col("__sure").isNull())
    ranked = flag.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "key", "score", "rank", "used_vectors", "reranked")
