"""Product codes of vectors: codebooks fitted by rounds of assignment and averaging, searched by partial distances.

Components become integers, floor(256 * x), so that distances and averages are exact whatever the order of the rows. A vector
is cut into PARTS equal parts; each part's codebook starts as that part of the vectors with the least ids. A round assigns
every part to its codebook's nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by
the floor of its parts' mean, component by component; entries without parts stay.

The nearest entry is found by partial-distance search: the dimensions of a part go by descending variance over its codebook.
A first distance gives each part a candidate, whose complete distance is the best one so far; then the squares of one
dimension after another are added for the pairs of part and entry that are left, and masks drop the pairs whose sum strictly
exceeds the best complete distance. Ties stay to the end.

Tasks send sums and counts of the entries that they have used, at most one row for each entry of each part; the driver gets
codebooks, which the parameters bound. Sums by label are a table of their own, joined with the coded rows, and both sides are
plain, so a frequent label can be split. Coded rows are written once.

Rows are dropped whose vector is null, holds a null, NaN or infinite component, or one of 2 ** 19 or more in size (its square
would not fit), or has not the length of the vector with the least id (a multiple of PARTS, else no row is kept). Null ids
come last; of repeated ids the vectors' order decides. Rows that repeat are coded alike, each a row of its own; with fewer
rows than ENTRIES the codebooks are as short; an empty table gives no rows. Extra columns pass through; those named like a
result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, with_columns, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_LARGEST = 2.0**19

#: Vectors that are searched at once; bounds a worker's memory.
BLOCK = 2048


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry and its squared distance, by partial distances; both arrays hold int64 rows."""
    n, k = len(parts), len(entries)
    order = np.argsort(-entries.var(axis=0), kind="stable")
    first = order[0]
    sums = (parts[:, first, None] - entries[None, :, first]) ** 2
    candidate = sums.argmin(axis=1)
    best = ((parts - entries[candidate]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    left = sums[row, entry]
    for d in order[1:]:
        left = left + (parts[row, d] - entries[entry, d]) ** 2
        alive = left <= best[row]
        row, entry, left = row[alive], entry[alive], left[alive]
    # complete distances now: the least of each row, at its first entry
    np.minimum.at(best, row, left)
    least = left == best[row]
    index = np.full(n, k, np.int64)
    np.minimum.at(index, row[least], entry[least])
    return index, best


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    """floor(SCALE * x) of the components, a row for each vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64)


def _coded(batch: pa.RecordBatch, column: str, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batch with their parts, indexes and distances; books: parts x entries x width."""
    count, _, width = books.shape
    for i in range(0, batch.num_rows, BLOCK):
        b = batch.slice(i, BLOCK)
        parts = integers(b.column(column), count * width).reshape(-1, count, width)
        found = [nearest(parts[:, p], books[p]) for p in range(count)]
        yield b, parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def usable(rows: DataFrame, vector: str, length: int) -> DataFrame:
    """Rows whose vector has this length and components that all are finite and small enough."""
    x = F.col(vector)
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c) < _LARGEST, F.lit(False)) & ~F.isnan(c))
    return rows.filter(x.isNotNull() & (F.size(x) == length) & fits)


def first_books(rows: DataFrame, vector: str, vec_id: str, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks of the vectors with the least ids; None where there is no vector that parts cut evenly."""
    x = F.col(vector)
    clean = F.forall(x, lambda c: F.coalesce(F.abs(c) < _LARGEST, F.lit(False)) & ~F.isnan(c))
    by_id = [F.asc_nulls_last(vec_id), F.asc(vector)]
    one = rows.filter(x.isNotNull() & clean).orderBy(*by_id).select(F.size(x)).first()
    if one is None or not one[0] or one[0] % parts:
        return None
    least = usable(rows, vector, one[0]).orderBy(*by_id).select(x).limit(entries).toArrow()
    return integers(least.column(0).combine_chunks(), one[0]).reshape(-1, parts, one[0] // parts).transpose(1, 0, 2).copy()


def improved(rows: DataFrame, vector: str, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries become the floor of their parts' means."""
    count, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((count, entries), np.int64), np.zeros((count, entries, width), np.int64)
        for batch in batches:
            for _, parts, index, _ in _coded(batch, vector, books):
                for p in range(count):
                    n[p] += np.bincount(index[:, p], minlength=entries)
                    np.add.at(sums[p], index[:, p], parts[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), *(pa.array(sums[p, e, d]) for d in range(width))], names=names)

    names = ["p", "e", "n", *(f"s{d}" for d in range(width))]
    partial = rows.select(vector).mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
    out = books.copy()
    for r in partial.groupBy("p", "e").agg(*(F.sum(x).alias(x) for x in names[2:])).collect():  # a row for each entry at most
        out[r["p"], r["e"]] = [r[x] // r["n"] for x in names[3:]]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, vector: str, books: np.ndarray) -> DataFrame:
    """rows without the vector, with code (two hex digits for each part) and error (squared distances, summed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _, index, distance in _coded(batch, vector, books):
                codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
                yield with_columns(b, drop=(vector,), code=pa.array(codes, pa.string()), error=pa.array(distance.sum(axis=1), pa.int64()))

    return rows.mapInArrow(run, schema_with(rows, drop=(vector,), code="string", error="bigint"))


def product_codes(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """rows without the vector, with code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256."""
    spark = rows.sparkSession
    rows = rows.drop("label_error", "codebooks_sha256")
    books = first_books(rows, vector, vec_id)
    if books is None:
        return spark.createDataFrame([], schema_with(rows, drop=(vector,), code="string", error="bigint", label_error="bigint", codebooks_sha256="string"))
    kept = usable(rows, vector, books.shape[0] * books.shape[2])
    for _ in range(rounds):
        books = improved(kept, vector, books)
    coded = written(encode(kept, vector, books), "product-codes")
    by_label = written(coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, F.col(label).eqNullSafe(F.col("__label"))).drop("__label").withColumn("codebooks_sha256", F.lit(digest(books)))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same over embeddings in DuckDB's SQL, every distance computed whole."""
    steps = [f"""
v AS MATERIALIZED (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x, len(embedding) // {parts} AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT vec_id, label, p, x[p * w + 1 : p * w + w] AS y FROM v, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id)) - 1 AS e, y AS z FROM q WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, p, y, min(struct_pack(d := list_sum([t * t FOR t IN list_transform(range(1, len(y) + 1), lambda i: y[i] - z[i])])::BIGINT, e := e)) AS b FROM q JOIN c{r} USING (p) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (SELECT p, e, list(f ORDER BY i) AS z FROM (SELECT p, b.e AS e, i, floor(sum(y[i]) / count(*))::BIGINT AS f FROM a{r}, (SELECT unnest(range(1, (SELECT max(w) FROM v) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.z, c{r}.z) AS z FROM c{r} LEFT JOIN m{r} USING (p, e))""")
    return f"""WITH {",".join(steps)},
k AS (SELECT vec_id, label, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM k"""
