"""Field-status coverage of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(records: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """A row for each required field: the other columns, field, status (missing where there is none)."""
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col("field_status")[f], F.lit("missing")).alias("status")) for f in required)))
    return records.withColumn("__f", rows).select(*[c for c in records.columns if c != "field_status"], "__f.field", "__f.status")


def field_coverage(records: DataFrame, required: tuple[str, ...], order: tuple[str, ...] = ("source", "section", "record_id"), samples: int = 5) -> DataFrame:
    """(field, status, n, samples): the first ids by order. The samples come from a window that Spark cuts short in each partition before it shuffles."""
    from pyspark.sql import Window

    rows = exploded(records, required)
    counts = rows.groupBy("field", "status").agg(F.count("*").alias("n"))
    first = rows.withColumn("__i", F.row_number().over(Window.partitionBy("field", "status").orderBy(*order))).filter(F.col("__i") <= samples)
    ids = first.groupBy("field", "status").agg(F.array_sort(F.collect_list(F.struct("__i", order[-1]))).alias("__s"))
    return counts.join(ids, ["field", "status"]).select("field", "status", "n", F.transform("__s", lambda s: s[order[-1]]).alias("samples"))


def coverage_gaps(records: DataFrame, required: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """(keys, field, status_counts): a map, its keys sorted. Two steps, so that a key's rows are counts when they meet."""
    counts = exploded(records, required).groupBy(*keys, "field", "status").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys, "field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))


def list_gaps(gaps: DataFrame, status: str, limit: int) -> DataFrame:
    """A top-k report: gaps with most records of the status."""
    return gaps.withColumn("n", F.coalesce(F.col("status_counts")[status], F.lit(0))).filter("n > 0").orderBy(F.col("n").desc(), *[c for c in gaps.columns if c != "status_counts"]).limit(limit)
