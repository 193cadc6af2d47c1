"""Byte-level BPE encoding and decoding.

A piece's bytes are the leaves of a segment tree; a leaf holds the rank of the pair that the live token starting there
makes with its right neighbour, an inner node the least rank below it. The root gives the next merge, the leftmost leaf
of that rank its place; a merge is three point updates, each logarithmic in the piece. Short pieces are merged many at a
time, their trees being rows of one array. Equal chunks of text are encoded once per worker (a bounded cache).

Null texts are encoded as the empty text: no ids. Very long texts are cut by the split pattern alone and encoded whole.
Repeated rows have equal ids each; an empty table stays empty. Extra columns pass through; columns named like a result are
replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import schema_with, slices, with_columns

_NONE = 1 << 62

#: White space as the split pattern has it (the Unicode property).
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_ODD = re.compile(rf"[{_SPACE}][{_SPACE}.,]|[^\w{_SPACE}][.,]|_[.,]|\A[{_SPACE}.,]|[{_SPACE}]\Z|\0")
_LONE_SPACE = regex.compile(rf"(?<=[^{_SPACE}])(?= [^{_SPACE}])")


def _cut(text: str) -> list[str]:
    """The text in chunks between which the pattern splits it in any case: before a lone space or line end, and, where each comes after a letter or digit, before a full stop or comma."""
    if not text:
        return []
    if _ODD.search(text) is None:
        return text.replace(" ", "\0 ").replace("\n", "\0\n").replace(".", "\0.").replace(",", "\0,").split("\0")
    return _LONE_SPACE.split(text)


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; they go to the workers with the task."""
    with open(path, "rb") as f:
        return f.read()


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the lowest rank next, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], _NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    end, before = list(range(1, n + 1)), list(range(-1, n))

    def put(leaf: int, rank: int) -> None:
        k = size + leaf
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while (rank := tree[1]) != _NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != rank:
                k += 1
        left = k - size
        right = end[left]
        stop = end[left] = end[right]
        put(right, _NONE)
        if stop < n:
            before[stop] = left
            put(left, ranks.get(piece[left : end[stop]], _NONE))
        else:
            put(left, _NONE)
        if (p := before[left]) >= 0:
            put(p, ranks.get(piece[p:stop], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Pairs:
    """Which two tokens make a third: a sorted array of left id * 2**32 + right id, and the ids made."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                    keys.append(left << 32 | right)
                    ids.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], _NONE)
        self.ids = np.append(np.array(ids, np.int64)[order], _NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], _NONE)


def merge_many(pieces: list[bytes], pairs: Pairs, of_byte: np.ndarray) -> list[np.ndarray]:
    """As merge(), for pieces of at most MANY bytes together: pieces of like size have their trees as rows of one array, and each step merges one pair in every row that has any."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    sizes = np.array([max(1, len(p) - 1).bit_length() for p in pieces])
    for bits in np.unique(sizes):
        rows, size = np.flatnonzero(sizes == bits), 1 << int(bits)
        lengths = np.array([len(pieces[i]) for i in rows])
        raw = np.frombuffer(b"".join(pieces[i].ljust(size, b"\0") for i in rows), np.uint8).reshape(-1, size)
        tokens = np.concatenate([of_byte[raw], np.zeros((len(rows), 1), np.int64)], 1)
        after = np.tile(np.arange(1, size + 2), (len(rows), 1))
        before = np.tile(np.arange(-1, size), (len(rows), 1))
        tree = np.full((len(rows), 2 * size), _NONE, np.int64)
        inside = np.arange(size - 1) < (lengths - 1)[:, None]
        tree[:, size : 2 * size - 1] = np.where(inside, pairs.rank(tokens[:, : size - 1], tokens[:, 1:size]), _NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            rank = tree[live, 1]
            k = np.ones(len(live), np.int64)
            for _ in range(bits):
                k *= 2
                k += tree[live, k] != rank
            left = k - size
            right = after[live, left]
            stop = after[live, right]
            previous = before[live, left]
            tokens[live, left], after[live, left], before[live, stop] = rank, stop, left
            first = previous < 0
            there = np.where(first, right, previous)  # where nothing is before, the dead leaf is written twice
            tree[live, right + size] = _NONE
            tree[live, left + size] = np.where(stop < lengths[live], pairs.rank(rank, tokens[live, np.minimum(stop, size)]), _NONE)
            tree[live, there + size] = np.where(first, _NONE, pairs.rank(tokens[live, there], rank))
            for leaf in (right, left, there):
                at = leaf + size
                for _ in range(bits):
                    at = at >> 1
                    tree[live, at] = np.minimum(tree[live, 2 * at], tree[live, 2 * at + 1])
            live = live[tree[live, 1] != _NONE]
        for row, i in enumerate(rows):
            ids, at, n = [], 0, lengths[row]
            tok, nxt = tokens[row].tolist(), after[row].tolist()
            while at < n:
                ids.append(tok[at])
                at = nxt[at]
            out[i] = ids
    return out


MANY = 64
#: Texts whose new chunks are merged together.
TEXTS_AT_ONCE = 512


class Codec:
    """Encodes texts to ids as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, rank_file: bytes, pattern: str, remembered: int = 200_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.pairs = Pairs(self.ranks)
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.whole = {t: struct.pack("<I", i) for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.remembered = remembered
        self.chunks: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Puts the ids of chunks into the cache."""
        split = {c: [p.encode() for p in self.find(c)] for c in chunks}
        new = list({p for ps in split.values() for p in ps} - self.whole.keys())
        short = [p for p in new if len(p) <= MANY] if (self.of_byte >= 0).all() else []
        made = dict(zip(short, merge_many(short, self.pairs, self.of_byte), strict=True))
        ids = {p: struct.pack(f"<{len(x)}I", *x) for p in new for x in [made.get(p) or merge(p, self.ranks)]}
        for c, ps in split.items():
            self.chunks[c] = b"".join([self.whole.get(p) or ids[p] for p in ps])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [_cut(t) for t in texts]
        if len(self.chunks) > self.remembered:
            self.chunks.clear()
        self._learn(set(chain.from_iterable(cut)) - self.chunks.keys())
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens long and ids binary (little-endian unsigned 32-bit); the text is dropped."""
    given = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))  # a vocabulary's fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*given.value)
        for b in slices(batches, TEXTS_AT_ONCE):
            ids = codec.encode_batch([t or "" for t in b.column(text).to_pylist()])
            yield with_columns(b, (text,), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()))

    return docs.mapInArrow(run, schema_with(docs, (text,), n_tokens="bigint", ids="binary"))


def decode(encoded: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds decoded binary, the bytes of the ids; the ids are dropped."""
    given = encoded.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*given.value)
        for b in slices(batches):
            yield with_columns(b, (ids,), decoded=pa.array([codec.decode(x or b"") for x in b.column(ids).to_pylist()], pa.binary()))

    return encoded.mapInArrow(run, schema_with(encoded, (ids,), decoded="binary"))


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text") -> DataFrame:
    """encode() and decode() of its ids in one worker: adds n_tokens long, ids and decoded binary; the text is dropped."""
    given = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*given.value)
        for b in slices(batches, TEXTS_AT_ONCE):
            ids = codec.encode_batch([t or "" for t in b.column(text).to_pylist()])
            columns = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([codec.decode(x) for x in ids], pa.binary())}
            yield with_columns(b, (text,), **columns)

    return docs.mapInArrow(run, schema_with(docs, (text,), n_tokens="bigint", ids="binary", decoded="binary"))


def default_ranks(spark: SparkSession) -> tuple[bytes, str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
