"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes what a stage returns as Parquet in the shared folder, reads it again as the next one's docs and deletes what the
stage had written besides.

In every stage a null text counts as the empty text and stays null where it stays; a null id is an id like any other for
what is kept; texts are read whole at any length; an empty table gives an empty table; columns that documents may have
besides its own stay, under their names, and helper columns have names of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontam, line_dedup, simhash, toxicity
from pagewright.llm.common import clean, made, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 stay; the model is fitted as op5 does, on these documents. Repeated rows have the same score, so they stay or go together. Without labels of both classes all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    return toxicity.score(docs, model, column="__score").filter("__score < 0.5").select(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; n_chars follows. A document of which nothing stays goes, unless it was empty. Rows that repeat both id and text are one place and lose the same lines."""
    names = docs.columns
    cut = line_dedup.dedup_lines(docs)
    cut = cut.filter((F.col("n_removed") == 0) | F.coalesce(F.trim("text") != "", F.lit(False)))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least id stays, null before all others; of several with that id the one whose text has the least hash, once."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go where at least a twentieth of the words, and one, lie in passages of the benchmark. Without items, or words, all stay; repeated rows stay or go together."""
    names = docs.columns
    found = decontam.judged(decontam.find_items(docs, table(spark, sf_dir, "benchmark")))
    return found.filter(~F.col("contaminated")).select(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded_matches: a row for each document; equal texts have equal ids."""
    ranks, pattern = bpe.default_ranks(spark)
    digest = docs.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("__sha"), "text")
    coded = bpe.round_trip(digest, ranks, pattern)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("__sha")).alias("decoded_matches"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: No SQL: the first stage fits a model, the second and third follow links.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), len(made(spark))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clean(spark, docs, since=others)  # what the stage wrote for itself, and its predecessor's rows
    return docs
