"""Batches of rows of like length, each within a budget, for models and tokenisers that take many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_batches(rows: DataFrame, size: Column, budget: int, padded: bool = False, most_rows: int = 10_000) -> DataFrame:
    """rows with batch long and batch_size long, sorted by size in each partition.

    Rows are ranged by size, so that like sizes are together and no partition holds all of a frequent size, and each
    partition is cut into batches, in order: a batch ends before its sizes' sum (padded: its rows times the largest size)
    would exceed the budget, or at most_rows. A row that is larger than the budget is a batch of its own. A null size is 0.
    Batches are numbered within the job: which rows are together may change with the partitions, the budget holds always.
    """
    ordered = rows.drop("batch", "batch_size").withColumn("batch_size", F.coalesce(size, F.lit(0)).cast("bigint"))
    # ties are spread by a hash of the row, so that a frequent size can be cut into ranges
    ordered = ordered.withColumn("__tie", F.xxhash64(*ordered.columns)).repartitionByRange("batch_size", "__tie").sortWithinPartitions("batch_size", "__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, used, count = TaskContext.get().partitionId() << 33, 0, 0, 0
        for b in batches:
            ids = []
            for x in b.column("batch_size").to_pylist():
                cost = (count + 1) * x if padded else used + x
                if count and (cost > budget or count == most_rows):
                    n, used, count = n + 1, 0, 0
                used, count = used + x, count + 1
                ids.append(base + n)
            kept = [c for c in b.schema.names if c != "__tie"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(ids, pa.int64())], names=[*kept, "batch"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields if f.name != "__tie")
    return ordered.mapInArrow(run, f"{kept}, batch bigint")
