"""Quality checks of pages and the audit that sums checks up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AUTH = r"(?i)\b(log ?in|sign ?in|authentication required|access denied)\b"
SEVERITY = {"skip": 0, "pass": 1, "warn": 2, "fail": 3, "error": 4}


def page_issue(words: Column, size: Column, status: Column, previous: Column, text: Column, extraction: Column) -> Column:
    """The page's issue types joined by a plus sign: empty or thin, with tiny_html below 1024 bytes; else auth_gate, content_regression (under half the words of before), extraction_incomplete (quality under 0.40), the first that holds; ok."""
    short = F.when(words == 0, "empty").when(words < 50, "thin")
    tiny = F.when(size < 1024, "tiny_html")
    gate = F.when(status.isin(401, 403) | ((words < 100) & text.rlike(_AUTH)), "auth_gate")
    later = F.coalesce(gate, F.when(previous.isNotNull() & (words < 0.5 * previous), "content_regression"), F.when(extraction < 0.40, "extraction_incomplete"))
    return F.coalesce(F.nullif(F.concat_ws("+", short, F.when(short.isNotNull() | (words < 100), tiny)), F.lit("")), later, F.lit("ok"))


def check(name: str, issues: DataFrame, warn: int = 1, fail: int | None = None) -> DataFrame:
    """One row: name, status, n_issues."""
    n = F.count("*")
    status = F.when(n >= fail, "fail") if fail is not None else F.when(F.lit(False), "fail")
    return issues.agg(n.alias("n_issues"), status.when(n >= warn, "warn").otherwise("pass").alias("status")).select(F.lit(name).alias("name"), "status", "n_issues")


def audit(checks: list[DataFrame]) -> DataFrame:
    """One row: the worst status (error, fail, warn, pass; skip is left out), checks, issues."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    rank = F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))))
    rows = rows.filter("status <> 'skip'")
    return rows.agg(F.max_by("status", rank[F.col("status")]).alias("status"), F.count("*").alias("n_checks"), F.sum("n_issues").alias("n_issues"))


def extraction_scan(pages: DataFrame, quality: Column) -> DataFrame:
    """One row: pages, incomplete (quality under 0.40), weak (under 0.70), mean."""
    rows = pages.select(quality.alias("q"))
    return rows.agg(F.count("*").alias("pages"), F.count_if(F.col("q") < 0.40).alias("incomplete"), F.count_if((F.col("q") >= 0.40) & (F.col("q") < 0.70)).alias("weak"), F.round(F.avg("q"), 6).alias("mean"))


def quality_adapter(issues: DataFrame) -> DataFrame:
    """quality: warns if any page is empty. issues: issue, n."""
    empty = F.sum(F.when(F.col("issue").startswith("empty"), F.col("n")).otherwise(0))
    n = F.coalesce(F.sum(F.when(F.col("issue") != "ok", F.col("n"))), F.lit(0))
    return issues.agg(n.alias("n_issues"), F.when(F.coalesce(empty, F.lit(0)) > 0, "warn").otherwise("pass").alias("status")).select(F.lit("quality").alias("name"), "status", "n_issues")


def retrieval_adapter(summary: DataFrame, good: float = 0.8, fair: float = 0.5) -> DataFrame:
    """retrieval: passes from a hit rate of 0.8, warns from 0.5. summary: one row with hit_rate, n_queries."""
    status = F.when(F.col("n_queries") == 0, "skip").when(F.col("hit_rate") >= good, "pass").when(F.col("hit_rate") >= fair, "warn").otherwise("fail")
    misses = F.round(F.col("n_queries") * (1 - F.coalesce("hit_rate", F.lit(0.0)))).cast("bigint")
    return summary.select(F.lit("retrieval").alias("name"), status.alias("status"), misses.alias("n_issues"))


def extraction_adapter(scan: DataFrame) -> DataFrame:
    """extraction: warns for under five incomplete pages, fails from five on. scan: as extraction_scan."""
    status = F.when(F.col("incomplete") == 0, F.when(F.col("weak") > 0, "warn").otherwise("pass")).when(F.col("incomplete") < 5, "warn").otherwise("fail")
    return scan.select(F.lit("extraction").alias("name"), status.alias("status"), (F.col("incomplete") + F.col("weak")).alias("n_issues"))


def catalogue_adapter(matched: DataFrame) -> DataFrame:
    """catalogue: informs only, so it always passes. matched: rows of cross_reference()."""
    return matched.agg(F.count_if(F.col("how").isNull()).alias("n_issues")).select(F.lit("catalogue").alias("name"), F.lit("pass").alias("status"), "n_issues")


def guarded(name: str, make) -> DataFrame | None:
    """The check's row; where its tables cannot be read or planned, a row with status error. make: a function without arguments."""
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    try:
        return make()
    except PySparkException:
        return SparkSession.getActiveSession().createDataFrame([(name, "error", 0)], "name string, status string, n_issues bigint")
