"""Line dedup by winnowing over line hashes.

A text's lines are cut further after sentence ends, so that a passage set into the middle of a line has whole lines of its
own; hashes are XXH64 of the lines' words. Of every least run of neighbouring lines with at least MIN_WORDS words the
rightmost line of least hash is selected: texts that share a run of MIN_WORDS words in whole lines share a selected line.
Where another place has a selected line's hash, the runs of MIN_WORDS words around the line that no line can be cut off at
one end take a hash of their own, which is joined with the first place of the same run (least doc_id, then text, then
position); all later places lose the run. Every longer repeated run is the union of such runs, so exactly the lines that
lie in a run of MIN_WORDS words or more that stands at an earlier place are deleted, whichever place that is.

A hash that occurs very often is one row after map-side aggregation; its places are joined with that one row.
Line hashes move in place of texts, until the lines to delete are joined with the documents.

Null and empty texts have no lines and stay. A null id comes before all others. Rows that repeat both id and text are one
place, so they lose the same lines. Very long texts are cut whole; an empty table stays empty. Extra columns pass through;
those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, slices, with_columns, written

MIN_WORDS = 30
_LINE = re.compile(r"[^\n]*?(?:[.!?]+[ \t]+|\n|\Z)", re.S)


def lines(text: str) -> list[str]:
    """The text cut after line ends and sentence ends; joined, the text again."""
    return [x for x in _LINE.findall(text) if x]


def hashed(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line; lines without words have hash 0."""
    split = [p.encode().split() for p in parts]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(ws)) if ws else 0 for ws in split], np.uint64).view(np.int64), np.array([len(ws) for ws in split], np.int32)


def _least_runs(hashes: list[int], counts: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """First and last position of each least run of lines with `least` words, its rightmost minimum and its words."""
    end, total, ring = 0, 0, []  # ring: positions of rising hashes, the minimum first
    head = 0
    for start in range(len(hashes)):
        while total < least and end < len(hashes):
            h = hashes[end]
            while len(ring) > head and hashes[ring[-1]] >= h:
                ring.pop()
            ring.append(end)
            total += counts[end]
            end += 1
        if total < least:
            break
        while ring[head] < start:
            head += 1
        yield start, end - 1, ring[head], total
        total -= counts[start]


def winnow(hashes: list[int], counts: list[int], least: int = MIN_WORDS) -> list[int]:
    """Positions that are the rightmost minimum of a least run of lines with `least` words."""
    out = []
    for _, _, at, _ in _least_runs(hashes, counts, least):
        if not out or out[-1] != at:
            out.append(at)
    return out


def runs_around(hashes: list[int], counts: list[int], seeds: set[int], least: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """First and last position of the runs that no line can be cut off at one end, where the least run from their start has its minimum among the seeds.

    A run of `least` words or more is the union of those within it: one starts at its first line, and from there on one ends at every line.
    """
    for start, last, at, total in _least_runs(hashes, counts, least):
        if at not in seeds:
            continue
        yield start, last
        rest = total - counts[start]
        while rest < least and (last := last + 1) < len(hashes):
            rest += counts[last]
            if rest < least:
                yield start, last


def _without_blank(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    full = np.flatnonzero(counts)
    return full, hashes[full], counts[full]


def _row(doc_id: str, text: str):
    return F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"))


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, hashes, counts, selected): for each document the hashes and word counts of its lines with words, and the selected positions. row, a hash of id and text, names the document together with its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, c, s = [], [], []
            for t in b.column("text").to_pylist():
                _, hh, cc = _without_blank(*hashed(lines(t or "")))
                h.append(hh)
                c.append(cc)
                s.append(np.array(winnow(hh.tolist(), cc.tolist(), least), np.int32))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *(_lists(x, t) for x, t in ((h, np.int64), (c, np.int32), (s, np.int32)))], names=["row", "doc_id", "hashes", "counts", "selected"])

    kind = dict(docs.dtypes)[doc_id]
    narrow = docs.select(_row(doc_id, text).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, f"row bigint, doc_id {kind}, hashes array<bigint>, counts array<int>, selected array<int>")


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)))


def _keyed(least: int):
    """For each row (a document and the positions of its selected lines that others share) the runs around them, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in slices(batches):
            of, key, first, last = [], [], [], []
            columns = [b.column(n) for n in ("seeds", "hashes", "counts")]
            for k in range(b.num_rows):
                seeds, hashes, counts = (np.asarray(x[k].values) for x in columns)
                data = hashes.tobytes()
                for i, j in runs_around(hashes.tolist(), counts.tolist(), set(seeds.tolist()), least):
                    of.append(k)
                    key.append(digest(data[8 * i : 8 * j + 8]))
                    first.append(i)
                    last.append(j)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("doc_id").take(at), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["row", "doc_id", "key", "first", "last"])

    return run


def repeated_runs(table: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, runs): the runs of lines with words to delete, a row for each document that has some."""
    kind = dict(table.dtypes)["doc_id"]
    same = lambda a, b: (F.col(f"{a}.row") == F.col(f"{b}.row")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    places = table.select("row", "doc_id", F.explode("selected").alias("at"), "hashes").select("row", "doc_id", "at", F.get("hashes", F.col("at")).alias("hash"))
    # written, so that the joins below have two plain sides and a frequent hash can be split
    shared = written(places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "shared")
    seeds = places.join(shared, "hash").groupBy("row", "doc_id").agg(F.collect_set("at").alias("seeds"))
    lined = seeds.alias("s").join(table.alias("t"), same("s", "t")).select("t.row", "t.doc_id", "seeds", "hashes", "counts")
    runs = written(lined.mapInArrow(_keyed(least), f"row bigint, doc_id {kind}, key bigint, first int, last int"), "runs")
    place = F.struct("doc_id", "row", "first")
    origin = written(runs.groupBy("key").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n"), "origins")
    later = runs.join(origin, "key").filter(place > F.col("origin"))
    return later.groupBy("row", "doc_id").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs deleted from the text, and n_lines, n_removed, removed_words long added."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_words")]
    table = written(line_table(docs, doc_id, text, least), "lines")
    cut = repeated_runs(table, least).select(F.col("row").alias("__row"), F.col("doc_id").alias("__id"), F.col("runs").alias("__runs"))
    rows = docs.select(*(F.col(f"`{c}`") for c in names), _row(doc_id, text).alias("__own"))
    joined = rows.join(cut, (F.col("__own") == F.col("__row")) & F.col(f"`{doc_id}`").cast("string").eqNullSafe(F.col("__id").cast("string")), "left").drop("__own", "__row", "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, totals, removed, gone = [], [], [], []
            for t, runs in zip(b.column(text).to_pylist(), b.column("__runs"), strict=True):
                parts = lines(t or "")
                drop = set()
                if runs.is_valid:
                    full = [i for i, p in enumerate(parts) if p.strip(" \t\n\r\x0b\x0c")]
                    depth = np.zeros(len(full) + 1, np.int64)
                    np.add.at(depth, np.asarray(runs.values.field("first")), 1)
                    np.add.at(depth, np.asarray(runs.values.field("last")) + 1, -1)
                    drop = {full[i] for i in np.flatnonzero(np.cumsum(depth))}
                    gone.append(sum(len(parts[i].encode().split()) for i in drop))
                    t = "".join(p for i, p in enumerate(parts) if i not in drop)
                else:
                    gone.append(0)
                texts.append(t)
                totals.append(len(parts))
                removed.append(len(drop))
            made = {text: pa.array(texts, pa.string()), "n_lines": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed_words": pa.array(gone, pa.int64())}
            yield with_columns(b, ("__runs",), **made)

    return joined.mapInArrow(run, schema_with(joined, ("__runs",), **{text: "string", "n_lines": "bigint", "n_removed": "bigint", "removed_words": "bigint"}))
