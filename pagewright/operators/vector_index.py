"""An approximate vector index: a coarse quantiser, inverted lists of residual codes, exact scores for the best.

Lists are the cells of a k-means quantiser; what is left of a vector beyond its cell's centre is coded in PARTS bytes by
codebooks of its own. Both are fitted on a bounded sample (SAMPLE rows with the least hash of their ids) and kept with the
index; every vector is indexed. Rows are ranged and sorted by list and id, so a search scans the row groups of the lists
that it probes, a frequent list spans several files, and of the scan's columns only list, id and code are read. Tasks add up
table look-ups of code distances and send on the best `candidates` of each query; those are joined with their vectors, and
exact distances give the result. Adding writes a new part by the fitted quantiser; deleted or replaced vectors are hidden by
tombstones until merge() leaves them out. All of it is published by the store's commit log.

Vectors that are null, hold a null, or have another length than the index are left out, as are null ids. Distances: squared
Euclidean inside, reported as l2; for cosine, index and ask with vectors of unit length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import commits, places
from . import vectors as exact

PARTS, ENTRIES = 16, 64
SAMPLE, ROUNDS = 20_000, 8
QUERIES_AT_ONCE = 4_096
ASKED = 256  # queries that settings are measured by


def _means(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means from rows spread over the sample; centres without rows stay."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


class Quantiser:
    """centres: lists x width; books: parts x entries x width / parts."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> Quantiser:
        width = sample.shape[1]
        parts = max(p for p in range(1, PARTS + 1) if width % p == 0)
        centres = _means(sample, min(lists, len(sample)))
        rest = (sample - centres[_nearest(sample, centres)]).reshape(len(sample), parts, -1)
        return Quantiser(centres, np.stack([_means(rest[:, p], min(ENTRIES, len(sample))) for p in range(parts)]))

    def coded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code (uint8, a byte a part) of each row."""
        near, parts = _nearest(rows, self.centres), len(self.books)
        rest = (rows - self.centres[near]).reshape(len(rows), parts, -1)
        return near, np.stack([_nearest(rest[:, p], self.books[p]) for p in range(parts)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray, number: int) -> np.ndarray:
        """Squared distances of what the queries leave of a list's centre to all entries: queries x parts x entries."""
        rest = (queries - self.centres[number]).reshape(len(queries), len(self.books), 1, -1)
        return ((rest - self.books[None]) ** 2).sum(3)

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        distance = (self.centres**2).sum(1) - 2 * queries @ self.centres.T
        return np.argsort(distance, 1, kind="stable")[:, :probes]

    def stored(self, spark: SparkSession) -> DataFrame:
        rows = [(name, list(a.shape), a.ravel().tolist()) for name, a in (("centres", self.centres), ("books", self.books))]
        return spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>")

    @staticmethod
    def read(spark: SparkSession, s: commits.Snapshot) -> Quantiser:
        rows = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in spark.read.parquet(s.folder(s.parts("quantiser")[0])).collect()}  # bounded by the sample
        return Quantiser(rows["centres"], rows["books"])


def _usable(rows: DataFrame, vec_id: str, column: str, width: int | None = None) -> DataFrame:
    x = F.col(column)
    ok = F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull())
    ok = ok if width is None else ok & (F.size(x) == width)
    return rows.filter(ok).select(F.col(vec_id).alias("vec_id"), x.cast("array<double>").alias("embedding"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _schema(kind: str) -> str:
    return f"list int, vec_id {kind}, code binary, embedding array<double>"


def _coded(rows: DataFrame, q: Quantiser, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4_096):
                b = whole.slice(i, 4_096)
                near, codes = q.coded(_matrix(b.column(1), q.centres.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], names=["list", "vec_id", "code", "embedding"])

    ranged = rows.mapInArrow(run, _schema(kind)).repartitionByRange("list", "vec_id")
    return ranged.sortWithinPartitions("list", "vec_id")


def lists_for(n: int, sample: int = SAMPLE) -> int:
    """About the square root of the number of vectors, so that cells and their members grow alike, but 20 rows of the sample a list at least."""
    return max(1, min(int(n**0.5), min(n, sample) // 20))


def add(rows: DataFrame, root: str, vec_id: str = "vec_id", column: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> commits.Snapshot:
    """Vectors into the index as one part; the first call fits the quantiser. Those whose id is there already are replaced."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[vec_id]
    made: dict[str, object] = {}

    def change(s: commits.Snapshot) -> commits.Change:
        first = {}
        if s.parts("quantiser"):
            q = Quantiser.read(spark, s)
        else:
            some = _usable(rows, vec_id, column).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # the bounded sample
            if some.empty:
                return commits.Change()
            width = len(some["embedding"][0])
            matrix = np.array([v for v in some["embedding"] if len(v) == width])
            q = Quantiser.fit(matrix, lists or lists_for(rows.count(), sample))
            first = {"quantiser": [commits.stage(q.stored(spark).coalesce(1), root, "quantiser", kind=kind)]}
            made.pop("part", None)
        if "part" not in made:
            made["part"] = commits.stage(_coded(_usable(rows, vec_id, column, q.centres.shape[1]), q, kind), root, "vectors", kept=True)
        ids = spark.read.schema(_schema(kind)).parquet(f"{root}/{made['part']['path']}").select("vec_id")
        old = {} if not s.parts("vectors") else {"tombstones": [commits.stage(ids, root, "tombstones")]}
        return commits.Change({"vectors": [made["part"]], **old, **first}, reads={"quantiser"})

    return commits.commit(spark, root, change)


def delete(ids: DataFrame, root: str, vec_id: str = "vec_id") -> commits.Snapshot:
    spark = ids.sparkSession
    return commits.commit(spark, root, lambda s: commits.Change({"tombstones": [commits.stage(ids.select(F.col(vec_id).alias("vec_id")), root, "tombstones")]} if s.parts("vectors") else {}))


def _live(spark: SparkSession, s: commits.Snapshot, numbers: list[int] | None = None) -> DataFrame:
    """Rows of some lists, or all, that no tombstone hides."""
    kind, rows, dead = s.parts("quantiser")[0]["kind"], None, None
    for p in s.parts("vectors"):
        one = spark.read.schema(_schema(kind)).parquet(s.folder(p)).withColumn("number", F.lit(p["number"]))
        one = one if numbers is None else one.filter(F.col("list").isin(numbers))
        rows = one if rows is None else rows.unionByName(one)
    for p in s.parts("tombstones"):
        one = spark.read.schema(f"vec_id {kind}").parquet(s.folder(p)).select(F.col("vec_id").alias("dead_id"), F.lit(p["number"]).alias("before"))
        dead = one if dead is None else dead.unionByName(one)
    if dead is None:
        return rows.drop("number")
    dead = dead.groupBy("dead_id").agg(F.max("before").alias("before"))
    return rows.join(dead, (F.col("vec_id") == F.col("dead_id")) & (F.col("before") > F.col("number")), "left_anti").drop("number")


def merge(spark: SparkSession, root: str) -> commits.Snapshot:
    """One part without what is hidden."""
    def change(s: commits.Snapshot) -> commits.Change:
        if len(s.parts("vectors")) < 2 and not s.parts("tombstones"):
            return commits.Change()
        rows = _live(spark, s).repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id")
        part = commits.stage(rows, root, "vectors", number=max(p["number"] for p in s.parts("vectors")))
        return commits.Change({"vectors": [part]}, {t: [p["path"] for p in s.parts(t)] for t in ("vectors", "tombstones")}, {"tombstones"})

    return commits.commit(spark, root, change)


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int, candidates: int = 10, vec_id: str = "vec_id", column: str = "embedding", with_self: bool = False) -> DataFrame:
    """(query_id, vec_id, distance, rank) as vectors.knn gives them by l2, from `probes` lists a query; k * candidates rows a query are scored exactly. queries: a stated set of vec_id, embedding."""
    s, kind = commits.latest(spark, root), dict(queries.dtypes)[vec_id]
    result = f"query_id {kind}, vec_id {kind}, distance double"
    if not s.parts("vectors"):
        return spark.createDataFrame([], result + ", rank int")
    q, out, block = Quantiser.read(spark, s), None, []

    def searched(block: list[tuple]) -> DataFrame:
        ids, asked = [i for i, _ in block], np.array([v for _, v in block])
        probed = q.probed(asked, probes)
        of_list = {int(number): np.flatnonzero((probed == number).any(1)) for number in np.unique(probed)}
        given = spark.sparkContext.broadcast((ids, asked, of_list, q))  # QUERIES_AT_ONCE queries, and the quantiser that the sample bounds
        keep = k * candidates

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked, of_list, q = given.value
            tables: dict[int, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                numbers, rows = b.column("list").to_numpy(), b.column("vec_id").to_pylist()
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
                for number in np.unique(numbers):
                    at, who = np.flatnonzero(numbers == number), of_list[int(number)]
                    if number not in tables:
                        tables.clear()  # rows come by list
                        tables[number] = q.tables(asked[who], number)
                    sums = tables[number][:, np.arange(codes.shape[1])[None], codes[at]].sum(2)
                    for j, w in enumerate(who.tolist()):
                        found.setdefault(w, []).append((sums[j], at))
                query, row, distance = [], [], []
                for w, parts in found.items():
                    d, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    best = np.argpartition(d, keep)[:keep] if len(d) > keep else np.arange(len(d))
                    query += [ids[w]] * len(best)
                    row += [rows[i] for i in at[best]]
                    distance += d[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(query, b.column("vec_id").type), pa.array(row, b.column("vec_id").type), pa.array(distance, pa.float64())], names=["query_id", "vec_id", "distance"])

        coded = _live(spark, s, list(of_list)).select("list", "vec_id", "code").mapInArrow(near, result)
        coded = coded if with_self else coded.filter("query_id <> vec_id")
        best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        chosen = coded.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= keep).select("query_id", "vec_id")
        whole = _live(spark, s, list(of_list)).select("vec_id", "embedding").join(chosen, "vec_id")
        there = spark.createDataFrame(list(zip(ids, asked.tolist(), strict=True)), f"query_id {kind}, __q array<double>")
        gap = F.aggregate(F.zip_with("embedding", "__q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        return whole.join(F.broadcast(there), "query_id").select("query_id", "vec_id", F.sqrt(gap).alias("distance"))  # the stated queries

    for row in _usable(queries, vec_id, column, q.centres.shape[1]).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERIES_AT_ONCE:
            out, block = searched(block) if out is None else out.unionByName(searched(block)), []
    if block:
        out = searched(block) if out is None else out.unionByName(searched(block))
    if out is None:
        return spark.createDataFrame([], result + ", rank int")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def probes_for(spark: SparkSession, root: str, rows: DataFrame, queries: DataFrame, k: int, target: float = 0.95, right: DataFrame | None = None) -> int:
    """The least number of lists a query that hold `target` of the exact k nearest of the queries (a stated set apart from those to be asked): which of a query's lists, by distance, hold them. right: those nearest, where they are known."""
    s = commits.latest(spark, root)
    q = Quantiser.read(spark, s)
    right = (exact.knn(rows, queries, k, "l2") if right is None else right).select("query_id", "vec_id")
    of_row = right.join(_live(spark, s).select("vec_id", "list"), "vec_id").groupBy("query_id").agg(F.collect_list("list").alias("lists"))  # k lists a query
    place = []
    for r in of_row.join(_usable(queries, "vec_id", "embedding").withColumnRenamed("vec_id", "query_id"), "query_id").toLocalIterator():
        at = np.empty(len(q.centres), int)
        at[q.probed(np.array([r["embedding"]]), len(q.centres))[0]] = np.arange(len(q.centres))
        place += at[r["lists"]].tolist()
    return int(np.quantile(place, target, method="higher")) + 1 if place else len(q.centres)


def settings_for(spark: SparkSession, root: str, rows: DataFrame, queries: DataFrame, k: int, target: float = 0.95) -> tuple[int, int]:
    """(probes, candidates) for search(): of ASKED of the queries, by their ids' hash, the lists that hold nearly all of the exact k nearest, and candidates doubled until `target` of the k nearest are found. Codes tell neighbours apart less well the closer vectors lie, so the more of them there are the more candidates a query needs."""
    where = places.fresh(spark, "asked")
    _usable(queries, "vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).write.parquet(f"{where}/queries")
    some = spark.read.parquet(f"{where}/queries")
    exact.knn(rows, some, k, "l2").write.parquet(f"{where}/right")
    right = spark.read.parquet(f"{where}/right")
    probes, candidates, n = probes_for(spark, root, rows, some, k, (1 + target) / 2, right), 10, rows.count()
    while k * candidates < n:
        found = search(spark, root, some, k, probes, candidates).select("query_id", "vec_id")
        if found.join(right, ["query_id", "vec_id"], "left_semi").count() >= target * right.count():
            break
        candidates *= 2
    return probes, candidates


def recall(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(n_queries, recall): the share of the exact k nearest that were found."""
    right = exact.knn(rows, queries, k, "l2").select("query_id", "vec_id")
    hit = found.filter(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return right.join(hit, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
