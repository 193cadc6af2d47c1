"""Exact vector search: a stated set of query vectors against all rows.

Blocks of vectors come as Arrow batches and are multiplied with the matrix of queries; of each batch only the k best of
each query go on, so what is shuffled is k rows a query and batch. The queries are collected in blocks of QUERY_BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4_096
AT_ONCE = 256  # queries that a batch is multiplied with at a time


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vec_id: str = "vec_id", column: str = "embedding", with_self: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank): ties by vec_id. metric: l2 (Euclidean) or cosine (1 - cosine). queries: vec_id, embedding."""
    out, block = None, []
    kind = dict(vectors.dtypes)[vec_id]
    for row in queries.select(vec_id, column).filter(F.col(column).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            part, block = _block(vectors, block, k, metric, vec_id, column, with_self, kind), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = _block(vectors, block, k, metric, vec_id, column, with_self, kind)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _distance(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query without the product's loss of digits for near vectors."""
    if metric == "cosine":
        return 1 - (v @ q) / (np.linalg.norm(q) * np.linalg.norm(v, axis=1))
    return np.sqrt(((v - q) ** 2).sum(1))


def _block(vectors, block, k, metric, vec_id, column, with_self, kind) -> DataFrame:
    ids = [i for i, _ in block]
    given = vectors.sparkSession.sparkContext.broadcast((ids, np.array([v for _, v in block], np.float64)))  # QUERY_BLOCK vectors at most

    def rough(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
        """Distances by a product, and what rounding may have changed of them."""
        if metric == "cosine":
            d = 1 - (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :])
        else:
            d = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T))
        return d, 1e-5 * max(1.0, float(np.abs(q).max(initial=0)), float(np.abs(v).max(initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = given.value
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows or not len(ids):
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            own = b.column(0).to_pylist()
            order = np.array(own, dtype=object)
            rows, cols = [], []
            far_off = []
            for at in range(0, len(ids), AT_ONCE):
                d, slack = rough(q[at : at + AT_ONCE], v)
                for i, near in enumerate(d, at):
                    some = np.argpartition(near, min(k + 1, len(own)) - 1)[: k + 1] if len(own) > k + 1 else np.arange(len(own))
                    some = np.flatnonzero(near <= near[some].max() + slack)  # with all ties, and what rounding may have put behind them
                    exact = _distance(q[i], v[some], metric)
                    best = sorted(zip(exact.tolist(), order[some], some.tolist(), strict=True), key=lambda x: x[:2])
                    best = [x for x in best if with_self or x[1] != ids[i]][:k]
                    rows += [i] * len(best)
                    cols += [j for _, _, j in best]
                    far_off += [x for x, _, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], b.column(0).type), pa.array([own[j] for j in cols], b.column(0).type), pa.array(far_off, pa.float64())], names=["query_id", "vec_id", "distance"])

    return vectors.select(vec_id, column).mapInArrow(run, f"query_id {kind}, vec_id {kind}, distance double")


def similarity(distance):
    """1 / (1 + d), 0 for a negative distance."""
    return F.when(distance >= 0, 1 / (1 + distance)).otherwise(0.0)
