"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python objects at once; bounds a worker's memory.
ROWS_AT_ONCE = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where a local session sets none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the plan behind it is run once, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagewright-{name}-{uuid.uuid4().hex}"
    made(spark).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_made: dict[str, list[str]] = {}


def made(spark: SparkSession) -> list[str]:
    """The folders that this application has written for its own use and not yet deleted."""
    return _made.setdefault(spark.sparkContext.applicationId, [])


def clean(spark: SparkSession, *keep: DataFrame, since: int = 0) -> None:
    """Deletes the folders that this application has written, but for its first `since` and those that `keep` reads: for when all other results have been taken."""
    files = {os.path.dirname(f) for df in keep for f in df.inputFiles()}
    paths, jvm = made(spark), spark._jvm
    for path in paths[since:]:
        if not any(f.rstrip("/").endswith(path[path.index("/") :]) for f in files):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            paths.remove(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole_text(name: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], step: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **columns: pa.Array) -> pa.RecordBatch:
    """The batch without `drop`, then the new columns."""
    kept = [n for n in batch.schema.names if n not in drop and n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(columns.values()), names=kept + list(columns))


def schema_with(df: DataFrame, drop: tuple[str, ...] = (), **types: str) -> str:
    """DDL of what with_columns() makes."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop and f.name not in types]
    return ", ".join(kept + [f"`{k}` {v}" for k, v in types.items()])


class Memo(dict):
    """A bounded cache: key to make(key). Emptied when full, so its memory does not grow with the input."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
