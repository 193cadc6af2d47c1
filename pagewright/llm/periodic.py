"""Periodic runs of words by partition refinement, and their collapse to one period.

Classes of positions with equal factors are refined from length to length (Crochemore): of the classes that the last length
has split, all parts but a largest one are small, and only the positions before members of small parts move, each into a
class of its own for what follows it. A position is in a small part at most log2(n) times, so n words take O(n log n)
moves. Neighbouring members of a class at a distance equal to the length start squares; they are found in buckets by
distance, which a changed link enters. As a factor that is itself a repetition has a nearer neighbour, the distance is the
smallest period, and squares at consecutive positions are one run.

Only runs of `least` words or more and `exponent` periods or more count. In such a run every factor of
least * (exponent - 2) // exponent + 1 words stands at least twice, so the stretches of words without another factor of
that length anywhere in the document are left out before the refinement; no run is lost.

Rows are independent of each other: nothing is shuffled, and a lost executor's rows are computed again. Null, empty and
blank texts have no words and no runs; texts are read whole at any length; repeated rows have equal results; an empty table
stays empty. Extra columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import schema_with, slices, with_columns

LEAST, EXPONENT = 24, 3

Run = tuple[int, int, int]  # start, length, period

_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Partition:
    """The classes of the positions of `symbols` by the next `length` symbols, members linked by position.

    The end of the text counts as a last position with a symbol of its own, so that factors that would pass it are alone.
    """

    def __init__(self, symbols: list[int], most: int):
        n = len(symbols)
        self.length, self.most = 1, most
        self.after, self.before = [-1] * (n + 1), [-1] * (n + 1)
        self.of, self.first, self.last, self.size = [0] * (n + 1), [], [], []
        self.buckets: dict[int, list[int]] = {}
        ids: dict[int, int] = {}
        for i, s in enumerate([*symbols, -1]):
            c = ids.get(s)
            if c is None:
                c = ids[s] = self._new()
            self._append(c, i)
        largest = max(range(len(self.size)), key=self.size.__getitem__)
        self.small = [self._members(c) for c in range(len(self.size)) if c != largest]

    def _new(self) -> int:
        self.first.append(-1)
        self.last.append(-1)
        self.size.append(0)
        return len(self.size) - 1

    def _near(self, left: int, right: int) -> None:
        gap = right - left
        if self.length <= gap <= self.most:
            self.buckets.setdefault(gap, []).append(left)

    def _append(self, c: int, i: int) -> None:
        tail = self.last[c]
        self.before[i], self.after[i] = tail, -1
        if tail < 0:
            self.first[c] = i
        else:
            self.after[tail] = i
            self._near(tail, i)
        self.last[c], self.of[i] = i, c
        self.size[c] += 1

    def _unlink(self, c: int, i: int) -> None:
        left, right = self.before[i], self.after[i]
        if left < 0:
            self.first[c] = right
        else:
            self.after[left] = right
        if right < 0:
            self.last[c] = left
        else:
            self.before[right] = left
            if left >= 0:
                self._near(left, right)
        self.size[c] -= 1

    def _members(self, c: int) -> list[int]:
        out, i, after = [], self.first[c], self.after
        while i >= 0:
            out.append(i)
            i = after[i]
        return out

    def refine(self) -> None:
        """From factors of `length` symbols to those of one more."""
        self.length += 1
        of, size, parts = self.of, self.size, {}
        for members in self.small:
            into: dict[int, int] = {}
            for j in members:
                if not j:
                    continue
                c = of[j - 1]
                if c not in into:
                    if size[c] == 1 and c not in parts:  # alone already
                        continue
                    into[c] = self._new()
                    parts.setdefault(c, []).append(into[c])
                self._unlink(c, j - 1)
                self._append(into[c], j - 1)
        self.small = []
        for c, new in parts.items():
            if size[c]:
                new.append(c)
            largest = max(new, key=size.__getitem__)
            self.small += [self._members(p) for p in new if p != largest]

    def squares(self) -> list[int]:
        """The positions, rising, of squares whose halves are factors of the present length."""
        return sorted({i for i in self.buckets.pop(self.length, ()) if self.after[i] == i + self.length})


def runs_of(symbols: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All runs of at least `least` symbols and `exponent` (2 or more) periods, by start, then period."""
    n, out = len(symbols), []
    if n < least:
        return out
    parts = Partition(symbols, n // exponent)
    while True:
        q, starts = parts.length, parts.squares()
        k = 0
        while k < len(starts):
            begin = k
            while k + 1 < len(starts) and starts[k + 1] == starts[k] + 1:
                k += 1
            length = starts[k] - starts[begin] + 2 * q
            if length >= least and length >= exponent * q:
                out.append((starts[begin], length, q))
            k += 1
        if q >= parts.most or not parts.small:
            # nothing left to split: all classes have one member, or only longer periods remain
            return sorted(out, key=lambda r: (r[0], r[2]))
        parts.refine()


def stretches(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Parts of the words, [first, end), outside of which no run has a word. Hashes that collide only make them longer."""
    n, f = len(words), least * (exponent - 2) // exponent + 1
    if n < least:
        return []
    one = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    factor = one[: n - f + 1].copy()
    for k in range(1, f):
        factor *= np.uint64(0x9E3779B97F4A7C15)
        factor += one[k : n - f + 1 + k]
    rising = np.sort(factor)
    again = np.unique(rising[1:][rising[1:] == rising[:-1]])
    if not len(again):
        return []
    where = np.minimum(np.searchsorted(again, factor), len(again) - 1)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], again[where] == factor, [False])).astype(np.int8)))
    return [(int(a), int(b) + f - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a > least - f]


def find_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    out = []
    for a, b in stretches(words, least, exponent):
        ids: dict[bytes, int] = {}
        found = runs_of([ids.setdefault(w, len(ids)) for w in words[a:b]], least, exponent)
        out += [(a + start, length, q) for start, length, q in found]
    return sorted(out, key=lambda r: (r[0], r[2]))


def longest(runs: list[Run]) -> Run | None:
    """The run of the most periods; of several the one that starts first, then the one of the least period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with n_runs long, runs (array of start, length, period in words, by start, then period), longest (the run of
    the most periods, null without runs) and collapsed (the words that stay, joined by one blank)."""
    names = ("n_runs", "runs", "longest", "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found, best, kept = [], [], []
            for t in b.column(text).to_pylist():
                words = (t or "").encode().split()  # of bytes: at blanks and \x09 to \x0D only
                runs = find_runs(words, least, exponent)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                best.append(found[-1][runs.index(longest(runs))] if runs else None)
                kept.append(b" ".join(collapse(words, runs)).decode())
            columns = [pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(_ARROW_RUN)), pa.array(best, _ARROW_RUN), pa.array(kept, pa.string())]
            yield with_columns(b, **dict(zip(names, columns, strict=True)))

    return docs.mapInArrow(run, schema_with(docs, n_runs="bigint", runs=f"array<{_RUN}>", longest=_RUN, collapsed="string"))
