"""Language-model scoring with a probabilistic suffix tree over words.

A text is a start, its words and an end. A context is the last 1 to DEPTH symbols before a word. It is a node of the tree
if it occurs MIN_COUNT times or more in the training texts and if its next words diverge from those of its suffix, the
context without its first symbol (Kullback-Leibler, DIVERGENCE nats or more). Next-word distributions are smoothed
towards the suffix's by absolute discounting: P(w|c) = max(n(cw) - DISCOUNT, 0) / n(c) + DISCOUNT t(c) / n(c) P(w|suffix),
t(c) the number of distinct next words; the root's towards a spelling model: P(w) = (n(w) + T S(w)) / (N + T), T the number
of distinct words. So every node's distribution sums to 1 over all words there can be. A word is scored by the node of the
longest kept context before it. The spelling model is a suffix tree too: its symbols are the bytes of UTF-8 and the word's
end, its contexts up to LETTERS bytes back to the word's start with a share of LETTER_SHARE or more, so its size is
bounded; the tree over words has no bound on its size and grows with the corpus.

Words are 64-bit hashes and contexts hashes of hashes. Texts are dealt into blocks of BLOCK_BYTES or one text. Per round
each block sends its distinct keys and counts, sorted and cut by ranges of the key, to the tasks that add them up, and has
the totals back in the same order: single words and pairs first, then, for each depth, the next longer keys after
contexts that occur often enough, together with the shares that the block has in its contexts' divergence and distinct next
words. As keys are distinct within a block, a frequent word or context has one entry a block, and no task holds all next
words of a context. Sums are of whole numbers, so results don't depend on how the texts are dealt. Nothing of the tree
goes to the driver but the spelling model and two sums. Intermediate tables are in the shared folder.

Null and empty texts have the end alone. Very long texts are a block of their own; a word of any length is spelled whole. Repeated rows each get a row. Without
training texts words are scored by a spelling model of even bytes. Columns other than the text pass; those named like a
result are replaced.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, made, shared_folder, written

DEPTH = 2
MIN_COUNT = 2
DIVERGENCE = 0.02
DISCOUNT = 0.75

LETTERS = 3
LETTER_SHARE = 2e-4
LETTER_SMOOTH = 4.0
LETTER_DIVERGENCE = 0.002

BLOCK_BYTES = 8 << 20  # of text in a block, and about 1.2 times as many of keys in a task that adds up
BUCKETS = 100_000  # Spark's limit; beyond it a bucket has several blocks
FAN_OUT = 1024  # parts that a block's keys are cut into at once
_SLICE = 1 << 20  # bytes that are cut into words at once

_COUNT, _CONTEXT, _LETTER, _SIZE = range(4)  # kinds of rows
_START, _END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # keys of the text's start and end
_ODD = np.uint64(0xD6E8FEB86659FD93)
_FIXED = float(1 << 12)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
_MESSAGE = "block bigint, kind int, level int, part int, size int, keys binary, counts binary, words binary, more binary"
_REPLY = "block bigint, kind int, level int, part int, body binary, n bigint, m bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit keys spread over all of the key."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_OF_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64), _ODD))])
    return _powers


def word_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and key of each word of lower-cased bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[data], [True]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    size = last - first
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters = data[~_BLANK[data]]
    value = _OF_BYTE[letters] * _power(int(size.max()) if len(size) else 1)[within]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    at = np.cumsum(size)
    return first, last, _mixed(total[at] - total[at - size])


def _pack(a: np.ndarray) -> bytes:
    """64-bit values, byte by byte of equal weight, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<i8" if a.dtype.kind == "i" else "<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(b: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _expand(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


# blocks


def blocks(docs: DataFrame, text: str, train: str, size: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: block, rows (the other columns), lengths, train, keys of its distinct symbols, their words, and the symbols of its texts in a row."""
    others = ", ".join(f"c{i}: {f.dataType.simpleString()}" for i, f in enumerate(f for f in docs.schema.fields if f.name not in (text, train)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            texts = batch.column(text).cast(pa.large_string())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
            first = 0
            for i, n in enumerate(sizes.tolist()):
                if seen and seen + n > size:
                    yield _block(at, held + [batch.slice(first, i - first)], text, train)
                    at, held, seen, first = at + 1, [], 0, i
                seen += n + 1
            held.append(batch.slice(first))
        if seen:
            yield _block(at, held, text, train)

    return docs.mapInArrow(run, f"block bigint, rows array<struct<{others}>>, lengths binary, train binary, keys binary, words binary, symbols binary")


def _block(block: int, batches: list[pa.RecordBatch], text: str, train: str) -> pa.RecordBatch:
    table = pa.Table.from_batches([b for b in batches if b.num_rows]).combine_chunks()
    texts = [t.as_py() or "" for t in table.column(text)]
    bytes_of, keys, inverse, starts, sizes, lengths, i, seen = [], [], [], [], [], [], 0, 0
    while i < len(texts):  # cut into words in pieces that fit into a processor's cache
        j, n = i, 0
        while j < len(texts) and (j == i or n + 4 * len(texts[j]) < _SLICE):
            n += 4 * len(texts[j])
            j += 1
        raw = [t.encode() for t in texts[i:j]]
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        first, last, key = word_keys(data)
        counts = np.diff(np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw])), prepend=0)
        distinct, place, at = _distinct(_framed(key, counts))
        inner = np.flatnonzero((distinct != _START) & (distinct != _END))
        word = at[inner] - 2 * np.searchsorted(np.cumsum(counts + 2), at[inner], "right") - 1
        start, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        start[inner], size[inner] = first[word] + seen, (last - first)[word]
        bytes_of.append(data)
        keys.append(distinct)
        inverse.append(place)
        starts.append(start)
        sizes.append(size)
        lengths.append(counts + 2)
        seen, i = seen + len(data), j
    distinct, place, at = _distinct(np.concatenate(keys))
    start, size = np.concatenate(starts)[at], np.concatenate(sizes)[at]
    ids = np.concatenate([place[o - len(k) : o][inv] for k, inv, o in zip(keys, inverse, np.cumsum([len(k) for k in keys]), strict=True)])
    # the distinct words, each with a blank after it
    to = np.cumsum(size + 1)
    joined = np.full(int(to[-1]), 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(to - size - 1, size) + within] = np.concatenate(bytes_of)[np.repeat(start, size) + within]
    often = np.argsort(-np.bincount(ids, minlength=len(distinct)), kind="stable")  # small numbers for frequent symbols, as these compress
    rank = np.empty(len(distinct), np.int32)
    rank[often] = np.arange(len(distinct))
    flags = np.array([bool(x) for x in table.column(train).to_pylist()], np.int64)
    rest = table.drop_columns([text, train])
    rows = pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) for c in rest.columns], names=[f"c{i}" for i in range(rest.num_columns)])
    made = {
        "block": pa.array([block], pa.int64()), "rows": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows), "lengths": pa.array([_pack(np.concatenate(lengths))], pa.binary()),
        "train": pa.array([_pack(flags)], pa.binary()), "keys": pa.array([_pack_keys(distinct)], pa.binary()), "words": pa.array([_squeeze(joined.tobytes())], pa.binary()), "symbols": pa.array([_pack(np.concatenate([often, rank[ids]]))], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, each key's place among them, and for each a position where it stands."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place, order[new]


def _framed(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of all words with a start before and an end after each text; counts: each text's words."""
    out = np.empty(len(words) + 2 * len(counts), np.uint64)
    size = counts + 2
    at = np.cumsum(size) - size
    inner = np.ones(len(out), bool)
    inner[at] = inner[at + size - 1] = False
    out[at], out[at + size - 1], out[inner] = _START, _END, words
    return out


class Walk:
    """A block's symbols and, as far as replies are there, the totals of its keys."""

    def __init__(self, row: dict, replies: dict[tuple[int, int], np.ndarray], depth: int, least: int):
        self.least, self.replies, self.words = least, replies, row["words"]
        self.lengths = lengths = _unpack(row["lengths"])
        self.first = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        pos = (np.arange(total) - np.repeat(self.first, lengths)).astype(np.int32)
        self.tokens = pos > 0
        self.train = np.repeat(_unpack(row["train"]).astype(bool), lengths)
        self.inner = np.ones(total, bool)  # positions with a symbol after them
        self.inner[self.first + lengths - 1] = False
        symbol = _unpack_keys(row["keys"])
        packed = _unpack(row["symbols"])
        # by level: the distinct keys, the place of each position's among them, the positions that have one, and how often the key occurs in the training texts
        self.uniq, self.inv, self.asked, self.n = [None, symbol], [None, packed[: len(symbol)].astype(np.int32)[packed[len(symbol) :]]], [None, np.ones(total, bool)], [None]
        keys = symbol = symbol[self.inv[1]]
        self._count(1)
        for level in range(2, depth + 2):
            asked = pos >= level - 1
            if level > 2:
                if self.n[level - 1] is None:
                    break
                asked[1:] &= self.n[level - 1][:-1] >= least
            after = _mixed(keys[:-1] * _ODD + symbol[1:])
            keys = np.concatenate([symbol[:1], after])
            uniq, place, _ = _distinct(after[asked[1:]])
            inv = np.zeros(total, np.int32)
            inv[asked] = place
            self.uniq.append(uniq)
            self.inv.append(inv)
            self.asked.append(asked)
            self._count(level)

    def _count(self, level: int) -> None:
        if not len(self.uniq[level]):
            self.n.append(np.zeros(len(self.train)))
        elif (_COUNT, level) not in self.replies:
            self.n.append(None)
        else:
            n = (self.replies[_COUNT, level] >> 1).astype(np.float64)[self.inv[level]]
            if level > 1:
                n[~self.asked[level]] = 0
            self.n.append(n)

    def reply(self, kind: int, level: int) -> np.ndarray:
        """Totals in the order of the keys that were asked for; empty where there were none."""
        return self.replies.get((kind, level), np.zeros(0, np.int64))

    def own(self, level: int) -> np.ndarray:
        """The block's own training counts of its distinct keys."""
        return np.bincount(self.inv[level][self.train & self.asked[level]], minlength=len(self.uniq[level]))

    def contexts(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of symbols after a context of that level, the context's place among the block's contexts, and the places of these among the distinct keys."""
        before = np.flatnonzero(self.inner & (self.n[level] >= self.least) & self.asked[level])
        key = self.inv[level][before]
        there = np.zeros(len(self.uniq[level]), bool)
        there[key] = True
        place = np.cumsum(there, dtype=np.int32) - 1
        return before + 1, place[key], np.flatnonzero(there)

    def root(self, spelling: Spelling, total: int, types: int) -> tuple[np.ndarray, np.ndarray]:
        """P(symbol) at each position, and what is to be taken off its natural log: P of a new word that is too long for a float is given without that."""
        spelled = spelling.words(_expand(self.words))
        n = self.reply(_COUNT, 1) >> 1
        off = np.where(n == 0, np.maximum(-600.0 - spelled, 0.0), 0.0)
        spelled = np.exp(np.maximum(spelled, -600.0))
        p = (n + types * spelled) / (total + types) if total else spelled
        return p[self.inv[1]], off[self.inv[1]]

    def smoothed(self, level: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P after contexts of that level, towards `below` where there is none; the positions after contexts, and which of these contexts are kept."""
        after, ctx, _ = self.contexts(level)
        reply = self.reply(_CONTEXT, level)
        out = below.copy()
        mass = (DISCOUNT * (reply >> 1))[ctx]
        out[after] = (np.maximum(self.n[level + 1][after] - DISCOUNT, 0.0) + mass * below[after]) / self.n[level][after - 1]
        return out, after, (reply & 1).astype(bool)[ctx]


# the spelling model


class Spelling:
    """Natural log probabilities of the next byte after the longest kept context; a blank is the word's end."""

    def __init__(self, grams: dict[int, dict[int, int]]):
        legal = ~_BLANK
        legal[32] = True
        root = np.zeros(256)
        for b, n in grams.get(1, {}).items():
            root[b] = n
        rows = [np.where(legal, (root + 1) / (root.sum() + legal.sum()), 0.0)]
        self.kept = {1: 0}
        for context in sorted(grams):
            if context == 1:
                continue
            up, n = rows[self._suffix(context)], sum(grams[context].values())
            c = np.zeros(256)
            c[list(grams[context])] = list(grams[context].values())
            some = c > 0
            if (c[some] / n * np.log(c[some] / n / up[some])).sum() < LETTER_DIVERGENCE:
                continue
            self.kept[context] = len(rows)
            rows.append((c + LETTER_SMOOTH * up) / (n + LETTER_SMOOTH))
        with np.errstate(divide="ignore"):
            self.log = np.log(np.array(rows))
        self.tables: list[np.ndarray] = []

    def __getstate__(self):
        return {"kept": self.kept, "log": self.log, "tables": []}

    def _tables(self) -> list[np.ndarray]:
        """For each length a context's row, or -1; made where they are used."""
        if not self.tables:
            self.tables = [np.full(256**d, -1, np.int16) for d in range(LETTERS + 1)]
            for context, row in self.kept.items():
                d = (context.bit_length() - 1) // 8
                self.tables[d][context - (1 << 8 * d)] = row
        return self.tables

    def _suffix(self, context: int) -> int:
        d = (context.bit_length() - 1) // 8
        while d:
            d -= 1
            context = (context & ((1 << 8 * d) - 1)) | 1 << 8 * d
            if context in self.kept:
                return self.kept[context]
        return 0

    def words(self, joined: bytes) -> np.ndarray:
        """ln S of each word of those that end with a blank."""
        data, contexts, size = _letters(joined)
        row = np.zeros(len(data), np.int16)
        for d, table in enumerate(self._tables()):
            found = table[contexts & ((1 << 8 * d) - 1)]
            row = np.where((size >= d) & (found >= 0), found, row)
        ends = np.flatnonzero(data == 32)
        return np.add.reduceat(self.log[row, data], np.concatenate([[0], ends[:-1] + 1])) if len(ends) else np.zeros(0)


def _letters(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words that end with a blank, the LETTERS bytes before each, and how many of these belong to the word and the blank before it."""
    data = np.frombuffer(joined, np.uint8)
    before = np.concatenate([np.full(LETTERS, 32, np.uint8), data])
    contexts = np.zeros(len(data), np.int32)
    for k in range(LETTERS):
        contexts = contexts << 8 | before[k : k + len(data)]
    at = np.arange(len(data), dtype=np.int32)
    last = np.maximum.accumulate(np.concatenate([np.full(1, -1, np.int32), np.where(data == 32, at, np.int32(-1))[:-1]])) if len(data) else at
    return data, contexts, np.minimum(at - last, LETTERS)


def letter_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longest contexts with their next byte, packed after a 1, and their counts."""
    data, contexts, size = _letters(b" ".join(words) + b" " if words else b"")
    contexts, size = contexts.astype(np.int64), size.astype(np.int64)
    context = (contexts & ((1 << 8 * size) - 1)) | 1 << 8 * size
    return np.unique(context << 8 | data, return_counts=True)


def _spelling(replies: DataFrame) -> Spelling:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("body").to_pylist():
                packed, n = _unpack(body).reshape(2, -1)
                for d in range(LETTERS + 1):
                    context = packed >> 8
                    here = context >= 1 << 8 * d
                    key = ((context[here] & ((1 << 8 * d) - 1)) | 1 << 8 * d) << 8 | packed[here] & 255
                    distinct, place = np.unique(key, return_inverse=True)
                    sums = np.bincount(place, n[here], len(distinct)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(distinct >> 8), pa.array((distinct & 255).astype(np.int32)), pa.array(sums)], names=["context", "letter", "n"])

    sums = written(replies.filter(F.col("kind") == _LETTER).select("body").mapInArrow(run, "context bigint, letter int, n bigint").groupBy("context", "letter").agg(F.sum("n").alias("n")), "letters")
    total = sums.filter("context = 1").agg(F.sum("n")).first()[0] or 0
    often = sums.groupBy("context").agg(F.sum("n").alias("of")).filter(F.col("of") >= max(1, LETTER_SHARE * total)).select("context")
    grams: dict[int, dict[int, int]] = {}
    for r in sums.join(often, "context").collect():  # at most LETTERS / LETTER_SHARE contexts of 256 letters
        grams.setdefault(r["context"], {})[r["letter"]] = r["n"]
    return Spelling(grams)


# messages and replies


def _cut(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of sorted keys begin, and the end."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _message(block: int, kind: int, level: int, part: int, keys: np.ndarray, counts: np.ndarray, words: bytes | None = None, more: np.ndarray | None = None) -> tuple:
    return block, kind, level, part, len(keys), _pack_keys(keys), _pack(counts), words if words is None else _squeeze(words), None if more is None else _pack(more)


def _messages(block: int, kind: int, level: int, parts: int, keys: np.ndarray, counts: np.ndarray, words: list[bytes] | None = None, more: np.ndarray | None = None) -> Iterator[tuple]:
    cut = _cut(keys, parts)
    for k in range(parts):
        at = slice(int(cut[k]), int(cut[k + 1]))
        if at.stop > at.start:
            yield _message(block, kind, level, k, keys[at], counts[at], None if words is None else b" ".join(words[at]) + b" ", None if more is None else more[at])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _first_round(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in ("block", "lengths", "train", "keys", "words", "symbols")}
                walk = Walk(row, {}, 1, MIN_COUNT)
                words = _expand(walk.words).split(b" ")
                yield _batch(list(_messages(row["block"], _COUNT, 1, parts, walk.uniq[1], walk.own(1), words)), _MESSAGE)
                yield _batch(list(_messages(row["block"], _COUNT, 2, parts, walk.uniq[2], walk.own(2))), _MESSAGE)

    return run


def _replies_of(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    found: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for kind, level, part, body in zip(*(table.column(n).to_pylist() for n in ("kind", "level", "part", "body")), strict=True):
        found.setdefault((kind, level), []).append((part, body))
    return {k: np.concatenate([_unpack(body) for _, body in sorted(v)]) for k, v in found.items()}


def _later_round(level: int, parts: int, depth: int, given, total: int, types: int):
    """Asks for keys of level + 1 symbols, if depth allows, and for contexts of level - 1."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.select(["block", "lengths", "train", "keys", "words", "symbols"]).to_pylist():
            walk = Walk(row, _replies_of(right), min(level, depth), MIN_COUNT)
            if level <= depth:
                rows += _messages(row["block"], _COUNT, level + 1, parts, walk.uniq[level + 1], walk.own(level + 1))
            below, _ = walk.root(given.value, total, types)
            for k in range(1, level - 1):
                below, _, _ = walk.smoothed(k, below)
            after, ctx, places = walk.contexts(level - 1)
            trained = walk.train[after]
            at, of = after[trained], ctx[trained]
            ratio = np.log(walk.n[level][at] / walk.n[level - 1][at - 1] / below[at]) - DIVERGENCE
            share = np.bincount(of, np.round(ratio * _FIXED), len(places)).astype(np.int64)  # whole numbers, so the order of adding up does not matter
            key, first = walk.inv[level][after], (walk.reply(_COUNT, level) & 1).astype(bool)
            context_of = np.zeros(len(first), np.int32)
            context_of[key] = ctx
            there = np.zeros(len(first), bool)
            there[key] = True
            distinct = np.bincount(context_of[first & there], minlength=len(places))
            rows += _messages(row["block"], _CONTEXT, level - 1, parts, walk.uniq[level - 1][places], distinct, more=share)
        return pa.Table.from_batches([_batch(rows, _MESSAGE)])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Adds up what all blocks sent of one part; replies in each block's own order."""
    out = []
    messages: dict[tuple[int, int], list[dict]] = {}
    for r in table.to_pylist():
        messages.setdefault((r["kind"], r["level"]), []).append(r)
    for (kind, level), rows in sorted(messages.items()):
        rows.sort(key=lambda r: r["block"])
        keys, counts = np.concatenate([_unpack_keys(r["keys"]) for r in rows]), np.concatenate([_unpack(r["counts"]) for r in rows])
        distinct, place, _ = _distinct(keys)
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)
        if kind == _COUNT:
            some = np.flatnonzero(counts > 0)
            flag = np.zeros(len(keys), np.int64)
            flag[some[np.unique(place[some], return_index=True)[1]]] = 1  # the first block that has the key in a training text counts it as distinct
            body = total[place] << 1 | flag
        else:
            body = (total << 1 | (np.bincount(place, np.concatenate([_unpack(r["more"]) for r in rows]), len(distinct)) >= 0))[place]
        ends = np.cumsum([r["size"] for r in rows])
        for r, end in zip(rows, ends.tolist(), strict=True):
            out.append((r["block"], kind, level, r["part"], _pack(body[end - r["size"] : end]), None, None))
        if kind == _COUNT and level == 1:
            words = [w for r in rows for w in _expand(r["words"]).split(b" ")[:-1]]
            first = np.zeros(len(distinct), np.int64)
            first[place[::-1]] = np.arange(len(keys))[::-1]
            seen = np.flatnonzero((total > 0) & (distinct != _START))
            out.append((None, _SIZE, 0, rows[0]["part"], None, int(total[seen].sum()), len(seen)))
            out.append((None, _LETTER, 0, rows[0]["part"], _pack(np.concatenate(letter_grams([words[i] for i in first[seen].tolist() if words[i]]))), None, None))
    return pa.Table.from_batches([_batch(out, _REPLY)])


def _finer(coarse: int, parts: int):
    """Cuts messages of `coarse` parts into `parts`, a multiple."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, words = _unpack_keys(r["keys"]), None if r["words"] is None else _expand(r["words"]).split(b" ")
                more = None if r["more"] is None else _unpack(r["more"])
                cut = _cut(keys, parts)
                counts, by = _unpack(r["counts"]), parts // coarse
                rows = []
                for k in range(r["part"] * by, (r["part"] + 1) * by):
                    at = slice(int(cut[k]), int(cut[k + 1]))
                    if at.stop > at.start:
                        rows.append(_message(r["block"], r["kind"], r["level"], k, keys[at], counts[at], None if words is None else b" ".join(words[at]) + b" ", None if more is None else more[at]))
                yield _batch(rows, _MESSAGE)

    return run


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile delete their shuffle files as they end: what they read is written then and not shuffled again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _answered(messages: DataFrame, sent: int, parts: int, name: str) -> DataFrame:
    if sent < parts:  # so that a block never sends more than FAN_OUT rows at once
        messages = messages.repartition(sent, "part").mapInArrow(_finer(sent, parts), _MESSAGE)
    # as many tasks as parts, so that what a task reads does not grow with the input
    with _swept(messages.sparkSession):
        return written(messages.repartition(parts, "part").groupBy("part").applyInArrow(_added, _REPLY), name)


def score(docs: DataFrame, train: Column, text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs its other columns, n_tokens, n_known, train_tokens long, base_score, score double. train: which rows are learned from."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score", "__train")]
    narrow = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    size = narrow.agg(F.sum(F.octet_length("__text") + 1)).first()[0] or 0
    parts = max(1, math.ceil(size / block_bytes))
    sent = parts if parts <= FAN_OUT else FAN_OUT
    parts = math.ceil(parts / sent) * sent
    # bucketed, so that no join moves the blocks themselves
    name = f"pagewright_blocks_{uuid.uuid4().hex}"
    dealt = blocks(narrow, "__text", "__train", block_bytes)
    path = f"{shared_folder(spark)}/{name}"
    made(spark).append(path)
    dealt.write.bucketBy(min(4 * parts, BUCKETS), "block").option("path", path).saveAsTable(name)
    table = spark.table(name)
    replies = _answered(table.drop("rows").mapInArrow(_first_round(sent), _MESSAGE), sent, parts, "replies")
    sizes = replies.filter(F.col("kind") == _SIZE).agg(F.sum("n"), F.sum("m")).first()
    total, types = sizes[0] or 0, sizes[1] or 0
    given = spark.sparkContext.broadcast(_spelling(replies))  # LETTERS / LETTER_SHARE contexts at most
    replies = replies.filter("block IS NOT NULL").select("block", "kind", "level", "part", "body")
    for level in range(2, depth + 2):
        more = table.drop("rows").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_later_round(level, sent, depth, given, total, types), _MESSAGE)
        replies = replies.unionByName(_answered(more, sent, parts, "replies").select(*replies.columns))
    denominator = math.log10(total + types + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            row = {n: left.column(n)[i].as_py() for n in ("block", "lengths", "train", "keys", "words", "symbols")}
            walk = Walk(row, _replies_of(right), depth, MIN_COUNT)
            p, off = walk.root(given.value, total, types)
            used = p
            for level in range(1, depth + 1):
                p, after, kept = walk.smoothed(level, p)
                at = after[kept]
                used = used.copy()
                used[at] = p[at]
            n = walk.n[1]
            add = lambda x: np.add.reduceat(np.where(walk.tokens, x, 0), walk.first)
            based = np.log10((walk.replies[_COUNT, 1] >> 1) + 1.0) - denominator
            columns = [walk.lengths - 1, add(n > 0), np.full(len(walk.lengths), total), add(based[walk.inv[1]]), add(np.log10(used) - off / math.log(10))]
            rows = pa.concat_arrays(left.column("rows").chunks).slice(i, 1).flatten()
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            out.append(pa.RecordBatch.from_arrays([rows.field(k) for k in range(rows.type.num_fields)] + [pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=result))
        return pa.Table.from_batches(out)

    result = [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name in names]
    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, ", ".join([*fields, "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"]))
