"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints of 64 bits are linked at RADIUS or fewer differing bits. Each bit position has a vector of RADIUS + 1 bits, not
zero; table v, one for each vector v that is not zero, masks out the bits whose vector is orthogonal to v. The RADIUS
vectors of a pair's differing bits leave some v orthogonal to all of them, so every pair within the radius agrees under
some table's mask: none is missed. Pairs that share a bucket are compared exactly.

Copies are one fingerprint, so groups of copies never meet in a bucket. Buckets are counted before any is formed; one of
more than BUCKET distinct fingerprints is dealt anew: the free bits of its mask fall into RADIUS + 1 blocks, a pair within the radius agrees on one of them, so
the bucket becomes RADIUS + 1 finer ones, again and again; a mask with f free bits has 2**f distinct fingerprints at most,
so this ends. Within a bucket only the links of a spanning forest are kept. Components come from alternating large-star
and small-star steps, each a join on minima, written to the shared folder.

Null and empty texts have fingerprint zero and are linked like any other. Null ids count in no minimum; a component of
null ids alone has a null id. Very long texts are shingled whole. Repeated rows each get a row; an empty table stays empty.
Extra columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, schema_with, slices, with_columns, written

RADIUS = 3
BITS = 64
BUCKET = 2_000


def fingerprint(text: str | None, seed: int = 42, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of the word shingles, repeats included."""
    ws = (text or "").encode().translate(ASCII_LOWER).split()
    if not ws:
        return 0
    grams = [b" ".join(ws)] if len(ws) < shingle else map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer; the text is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column(text).to_pylist()], np.uint64).view(np.int64)
            yield with_columns(b, (text,), **{column: pa.array(fp)})

    return docs.mapInArrow(run, schema_with(docs, (text,), **{column: "bigint"}))


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each vector; bit i has the vector i mod (2**(radius+1) - 1) + 1, so that all masks are of like weight."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finer(mask: int, radius: int) -> list[int]:
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j :: radius + 1]) for j in range(radius + 1)]


def _ones(x: np.ndarray) -> np.ndarray:
    """Set bits of signed 64-bit integers; the sign bit is one of them."""
    return np.bitwise_count(x.view(np.uint64))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within the radius; as much memory as one row of distances."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(fps) - 1):
        for j in np.flatnonzero(_ones(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            if a != b:
                parent[b] = a
                out.append((int(fps[i]), int(fps[j])))
    return out


def _links_in_buckets(radius: int):
    """Rows (mask, key, fp), sorted, to links (a, b); buckets are of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)  # the bucket that may go on in the next batch

        def linked(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            two = starts[ends - starts == 2]
            near = _ones(rows[2, two] ^ rows[2, two + 1]) <= radius
            out = list(zip(rows[2, two[near]].tolist(), rows[2, two[near] + 1].tolist(), strict=True))
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                out += _forest(rows[2, s:e], radius)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            rows = np.concatenate([rest, np.stack([b.column(n).to_numpy() for n in ("mask", "key", "fp")])], 1)
            if not rows.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            rest = rows[:, starts[-1] :]
            yield linked(rows, starts[:-1], starts[1:])
        if rest.shape[1]:
            yield linked(rest, np.array([0]), np.array([rest.shape[1]]))

    return run


def _dealt(radius: int):
    """Rows (mask, fp) to one for each finer mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer: dict[int, list[int]] = {}
        for b in batches:
            mask, fp = b.column("mask").to_numpy(), b.column("fp").to_numpy()
            for m in np.unique(mask).tolist():
                if m not in finer:
                    finer[m] = [_signed(x) for x in _finer(m & (1 << 64) - 1, radius)]
            new = np.array([finer[m] for m in mask.tolist()], np.int64).reshape(-1, radius + 1)
            yield pa.RecordBatch.from_arrays([pa.array(new.ravel()), pa.array(np.repeat(fp, radius + 1))], names=["mask", "fp"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all that are within the radius. Buckets are counted first, with partial sums in the map tasks; the rows of those that are too large are dealt to finer masks where they are, so no task ever holds such a bucket."""
    tables = F.array(*(F.lit(_signed(m)).cast("bigint") for m in masks(radius)))
    rows, found = distinct.select(F.explode(tables).alias("mask"), "fp"), None
    while True:
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("mask", "key"), "simhash-large")
        some = bool(large.take(1))
        small = keyed.join(large, ["mask", "key"], "left_anti").select("mask", "key", "fp") if some else keyed
        sorted_rows = small.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        new = written(sorted_rows.mapInArrow(_links_in_buckets(radius), "a bigint, b bigint"), "simhash-links")
        found = new if found is None else found.unionByName(new)
        if not some:
            return found
        rows = written(keyed.join(large, ["mask", "key"], "left_semi").select("mask", "fp").mapInArrow(_dealt(radius), "mask bigint, fp bigint").distinct(), "simhash-finer")


def components(found: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable, for every node with a link (a, b)."""
    edges = written(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        edges = written(small.filter("u <> v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _members(docs: DataFrame, doc_id: str, text: str, radius: int) -> DataFrame:
    """docs without the text, with fp, component_id and __component, the fingerprint that names the component: ids may be null or repeated, so component_id does not."""
    printed = written(fingerprints(docs.drop("fp", "component_id"), text), "fingerprints")
    distinct = printed.groupBy("fp").agg(F.min(doc_id).alias("least"))
    member = components(links(distinct.select("fp"), radius))
    joined = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("__component", F.coalesce("component", "fp"))
    ids = joined.groupBy("__component").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "__component").select("fp", "component_id", "__component")
    return printed.join(named, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without the text, with fp (signed 64-bit fingerprint) and component_id, the least id of its component."""
    return _members(docs, doc_id, text, radius).drop("__component")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The document with the least id of each component, null only where all are; of rows with this id, that with the least text hash, once."""
    names = docs.columns
    key = lambda i, h: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), h.cast("string"))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("__hash"))
    found = _members(narrow, "doc_id", "text", radius)
    least = found.groupBy("__component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash")).alias("k"))
    kept = least.select(key(F.col("k.doc_id"), F.col("k.__hash")).alias("__key"))
    marked = docs.withColumn("__key", key(F.col(doc_id), F.xxhash64(text)))
    one = Window.partitionBy("__key").orderBy(F.lit(0))
    out = marked.join(kept, "__key", "left_semi").withColumn("__n", F.row_number().over(one)).filter("__n = 1")
    return out.select(*(F.col(f"`{n}`") for n in names))
