"""The approximate vector index: recall against the exact search, replaced and deleted vectors, odd rows."""

import numpy as np

from pagewright.operators import vector_index, vectors
from pagewright.sources import commits

DDL = "vec_id long, embedding array<float>"


def frame(spark, ids, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, rows, strict=True)], DDL)


def test_recall_on_clusters_with_few_probes(spark, tmp_path):
    rng, root = np.random.default_rng(1), str(tmp_path / "v")
    centres = rng.normal(0, 3, (40, 24))
    rows = centres[rng.integers(0, 40, 3_000)] + rng.normal(0, 0.6, (3_000, 24))
    all_rows = frame(spark, range(3_000), rows).repartition(6)
    queries = all_rows.filter("vec_id % 50 = 0")
    s = vector_index.add(all_rows, root)
    lists = len(vector_index.Quantiser.read(spark, s).centres)
    probes = vector_index.probes_for(spark, root, all_rows, all_rows.filter("vec_id % 50 = 25"), 10, 0.95)
    assert lists == vector_index.lists_for(3_000) == 54 and probes < lists / 4
    found = vector_index.search(spark, root, queries, 10, probes)
    got = vector_index.recall(found, all_rows, queries, 10).first()
    assert got["n_queries"] == 60 and got["recall"] >= 0.9
    true = {(r["query_id"], r["vec_id"]): r["distance"] for r in vectors.knn(all_rows, queries, 3_000, "l2").collect()}
    assert all(abs(true[r["query_id"], r["vec_id"]] - r["distance"]) < 1e-5 for r in found.collect())  # distances are exact
    every = vector_index.search(spark, root, queries, 10, lists, 300)  # all lists, all rows: the exact result
    assert vector_index.recall(every, all_rows, queries, 10).first()["recall"] == 1.0


def test_replaced_deleted_and_merged(spark, tmp_path):
    rng, root = np.random.default_rng(2), str(tmp_path / "v")
    rows = rng.normal(0, 1, (200, 8))
    vector_index.add(frame(spark, range(200), rows), root)
    moved = rows.copy()
    moved[:50] += 100
    vector_index.add(frame(spark, range(50), moved[:50]), root)
    vector_index.delete(frame(spark, range(60, 80), rows[60:80]), root)
    held = [i for i in range(200) if not 60 <= i < 80]
    queries = frame(spark, [1000, 1001], [moved[3] + 0.01, rows[150] + 0.01])
    lists = vector_index.lists_for(200)
    want = {(r["query_id"], r["vec_id"]) for r in vectors.knn(frame(spark, held, moved[held]), queries, 5, "l2").collect()}
    ask = lambda: {(r["query_id"], r["vec_id"]) for r in vector_index.search(spark, root, queries, 5, lists, 40).collect()}
    assert ask() == want and (1000, 3) in want
    s = vector_index.merge(spark, root)
    assert len(s.parts("vectors")) == 1 and not s.parts("tombstones") and ask() == want
    assert s.read(spark, "vectors", "vec_id long").count() == len(held) and vector_index.merge(spark, root) == s


def test_odd_rows_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "v")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (10, None)], DDL)
    assert vector_index.search(spark, root, q, 3, 1).count() == 0
    assert vector_index.add(q.filter("vec_id = 10"), root).version == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 0.0]), (6, [1.0, 1.0, 1.0]), (7, [1.0, 0.0])], DDL)
    vector_index.add(odd.filter("vec_id <> 6 OR vec_id IS NULL"), root)
    vector_index.add(odd.filter("vec_id = 6"), root)  # of another length
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in vector_index.search(spark, root, q, 3, 5).collect()} == {(9, 1, 1), (9, 7, 2), (9, 2, 3)}
    assert commits.latest(spark, root).version == 2
