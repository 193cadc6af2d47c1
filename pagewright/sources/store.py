"""A store: a folder of Parquet tables with fixed, versioned schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


#: Table to DDL, for each version in which the table changed.
SCHEMAS = {
    "crawl_runs": {1: "id bigint, started_at timestamp, ended_at timestamp, config string"},
    "pages": {
        1: "id bigint, canonical_url string, url string, final_url string, domain string, title string, path_hash string, content_hash string, raw_hash string, prev_content_hash string, word_count int, http_status int, content_type string, render_mode string, crawled_at timestamp, last_crawl_run_id bigint, html string, markdown string",
        2: "id bigint, canonical_url string, url string, final_url string, domain string, title string, path_hash string, content_hash string, raw_hash string, prev_content_hash string, word_count int, http_status int, content_type string, render_mode string, crawled_at timestamp, last_crawl_run_id bigint, html string, markdown string, etag string, last_modified string, source_type string, content_flags array<string>",
    },
    "page_versions": {1: "id bigint, page_id bigint, crawl_run_id bigint, content_hash string, raw_hash string, crawled_at timestamp"},
    "records": {1: "record_id string, source string, section string, protocol string, method string, path string, base_url string, api_version string, description string, docs_url string, record string, updated_at timestamp"},
    "record_sources": {1: "record_id string, field_name string, doc_url string, doc_hash string, created_at timestamp"},
    "review_queue": {1: "id bigint, kind string, source string, section string, record_id string, field_name string, reason string, status string, created_at timestamp"},
    "inventories": {1: "id bigint, source string, section string, generated_at timestamp, url_count int, inventory_hash string"},
    "inventory_entries": {1: "inventory_id bigint, canonical_url string, status string, last_error string, http_status int, fetched_at timestamp"},
    "scope_ownership": {1: "scope string, url string, owner string, priority int"},
    "coverage_gaps": {1: "source string, section string, protocol string, field_name string, status_counts map<string,bigint>, samples map<string,array<string>>"},
    "changelog_entries": {1: "source string, section string, source_url string, entry_date string, entry_text string, content_hash string, created_at timestamp"},
}


def schema(table: str, version: int = VERSION) -> T.StructType:
    known = SCHEMAS[table]
    return _struct(known[max(v for v in known if v <= version)])


def init(spark: SparkSession, folder: str) -> None:
    """Writes an empty table for each that is missing; tables that are there stay as they are."""
    for name in SCHEMAS:
        try:
            spark.read.parquet(f"{folder}/{name}").schema  # noqa: B018
        except AnalysisException as e:  # a table that is there but cannot be read is no missing one
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            spark.createDataFrame([], schema(name)).write.mode("ignore").parquet(f"{folder}/{name}")
    spark.createDataFrame([(VERSION,)], "version int").write.mode("ignore").parquet(f"{folder}/_schema_version")


def version(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/_schema_version").agg(F.max("version")).first()[0]


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table in the newest schema; columns that an older store lacks are null. A store of a newer version is refused."""
    if (found := version(spark, folder)) > VERSION:
        raise ValueError(f"ESCHEMAVER: the store has version {found}, this code knows {VERSION}")
    rows = spark.read.parquet(f"{folder}/{name}")
    empty = spark.createDataFrame([], schema(name))
    return empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)


def migrate(spark: SparkSession, folder: str, target: str, dry_run: bool = True) -> list[str]:
    """The tables whose schema changes; unless it is a dry run, the store in the newest schema at `target`."""
    have = version(spark, folder)
    changed = [n for n in SCHEMAS if schema(n, have) != schema(n)]
    if not dry_run:
        for name in SCHEMAS:
            open_table(spark, folder, name).write.parquet(f"{target}/{name}")
        spark.createDataFrame([(VERSION,)], "version int").write.parquet(f"{target}/_schema_version")
    return changed


def get_page(pages: DataFrame, url: str) -> DataFrame:
    """A point read by the canonical form of the URL."""
    from ..functions import urls

    return pages.filter(F.col("canonical_url") == urls.canonical(F.lit(url)))


def write_index(chunks: DataFrame, path: str, by: str, rows_per_file: int = 1_000_000) -> None:
    """Range-partitioned, so that filters on `by` skip files."""
    chunks.repartitionByRange(by).sortWithinPartitions(by).write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def compact(spark: SparkSession, path: str, target: str, files: int, rows_per_file: int = 1_000_000) -> None:
    spark.read.parquet(path).repartition(files).write.option("maxRecordsPerFile", rows_per_file).parquet(target)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed."""
    a, b = old.select("path", F.col("sha256").alias("a")), new.select("path", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change IS NOT NULL")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to a log of JSON lines; a failed job leaves no part of a file behind."""
    rows.write.mode("append").json(path)
