"""Shards of near equal size from groups that stay together, by longest-processing-time scheduling.

Rows with equal texts (null apart from the empty text) are a group; its size is the sum of its rows' sizes. Groups, largest
first, go to the least loaded shard, as a heap of loads gives it. Groups of one size class are dealt in one step: the heap
pops that many of its equal steps, which a search for the level that the loads reach counts, and the heap itself gives the
last ones. Sizes with at most BITS binary digits are classes of their own; larger ones are classed by their first BITS
digits and dealt with the mean of their class, which is off by less than 1 in 2 ** (BITS - 1). So what the driver gets is a
row for each class: at most 2 ** BITS, and half as many for each doubling beyond, however many groups there are.

Which groups of a class go where is decided by their rank in it, and a row's slot by its rank in its shard: both are counted
in buckets of the digest's, or the id's hash, first digits, whose counts are then added up over the buckets before, so no
class, group or shard has to fit into one task. A group that holds a third of all rows is one row after map-side
aggregation, its shard comes back to its rows by a join whose plain sides adaptive execution can split, and its rows are
dealt to the buckets by their ids. Digests move in place of texts.

A null text has size OVERHEAD; repeated rows are rows of their own with slots of their own, in any order among themselves;
null ids count like any other; very long texts are read whole; an empty table gives no rows. Extra columns pass through;
those named like a result are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OVERHEAD, BITS = 16, 12

#: Rows that a bucket of ranks holds on average.
BUCKET_ROWS = 200_000


def deal(loads: list[float], count: int, size: float) -> list[int]:
    """How many of `count` groups of one size go to each shard, each to the least loaded one (ties: the first); raises loads."""
    got = [0] * len(loads)
    if size and count > 4 * len(loads):
        # the most steps of the heap that end at or below one level: all of them come before any other step
        taken = lambda level: [max(0, int((level - x) // size)) for x in loads]
        low, high = min(loads), min(loads) + size * (count + 1)
        while high - low > size / 2:
            mid = (low + high) / 2
            low, high = (mid, high) if sum(taken(mid)) <= count else (low, mid)
        got = taken(low)
    heap = [(x + n * size, shard) for shard, (x, n) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        got[shard] += 1
    for load, shard in heap:
        loads[shard] = load
    return got


def schedule(classes: Iterable[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(class, groups, their sizes' sum), largest class first, to (class, the shards that get groups of it, how many go to each of them or one before)."""
    loads, out = [0] * shards, []
    for name, count, total in classes:
        size = total // count if total % count == 0 else total / count
        got = [(shard, n) for shard, n in enumerate(deal(loads, count, size)) if n]
        out.append((name, [shard for shard, _ in got], list(accumulate(n for _, n in got))))
    return out


def size_class(size: Column, bits: int = BITS) -> Column:
    """The size with all binary digits after its first `bits` set to 0."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - bits, F.lit(0))).cast("bigint")
    return size - size % step


def ranked(rows: DataFrame, n: int, key: str, order: Column, hashed: Column, name: str) -> DataFrame:
    """rows, n of them, with the column `name`: ranks 0, 1, ... within each key (never null), by `hashed` (a long), then `order`.

    A power of two of buckets, by the hash's first digits, holds the rows of a key; ranks within a bucket follow those of all
    buckets before. As the order does not depend on the number of buckets, neither do the ranks.
    """
    digits = (n // BUCKET_ROWS).bit_length() + 3
    placed = rows.withColumn("__hash", hashed).withColumn("__bucket", F.shiftright("__hash", 64 - digits))
    sums = placed.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(key, "__bucket").orderBy("__hash", order)
    local = placed.withColumn("__rank", F.row_number().over(within) - 1)
    joined = local.join(starts, (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(name, (F.col("__start") + F.col("__rank")).cast("bigint")).drop("__hash", "__bucket", "__key", "__b", "__start", "__rank")


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", overhead: int = OVERHEAD) -> DataFrame:
    """docs without the text, with size, text_crc32, law, shard, slot (gapless from 0 in a shard) and grown_shard (null).

    All other columns are written once and shuffled, so select what is wanted first.
    """
    spark, raw = docs.sparkSession, F.col(text).cast("string")
    measures = {
        "size": (F.coalesce(F.octet_length(raw), F.lit(0)) + overhead).cast("bigint"), "text_crc32": F.crc32(F.coalesce(raw, F.lit("")).cast("binary")),
        "__digest": F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    rows = written(docs.select(*kept, *(c.alias(name) for name, c in measures.items())), "shard-rows")
    groups = rows.groupBy("__digest").agg(F.sum("size").alias("__total"), F.count("*").alias("__rows"))
    groups = written(groups.withColumn("__class", size_class(F.col("__total"))), "shard-groups")
    classes = groups.groupBy("__class").agg(F.count("*").alias("n"), F.sum("__total").alias("total"), F.sum("__rows").alias("rows")).orderBy(F.desc("__class")).collect()
    ends = spark.createDataFrame(schedule(((r["__class"], r["n"], r["total"]) for r in classes), shards), "__c bigint, __shards array<int>, __ends array<bigint>")
    at = ranked(groups, sum(r["n"] for r in classes), "__class", F.col("__digest"), F.xxhash64("__digest"), "__at")
    of_class = at.join(F.broadcast(ends), F.col("__class") == F.col("__c"))  # bounded as the classes are
    shard_of = written(of_class.select(F.col("__digest").alias("__d"), F.get("__shards", F.size(F.filter("__ends", lambda e: e <= F.col("__at")))).alias("shard")), "shard-of-group")
    put = written(rows.join(shard_of, F.col("__digest") == F.col("__d")).drop("__d"), "shard-of-row")
    placed = ranked(put, sum(r["rows"] for r in classes), "shard", F.col(doc_id), F.xxhash64(F.col(doc_id), F.col("__digest")), "slot")
    return placed.drop("__digest").withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
