"""Toxicity through a noisy channel: obfuscated words are restored, then the restored text is scored.

A word with digits or signs between letters, with letters repeated three times or more, or spelled out with blanks or
signs between its letters is a character lattice of any length: each sign may stand for the letters it resembles, for
nothing or for the end of a word; blanks between three or more single characters for nothing or the end of a word; each
run of a letter for one, two or all of them. Viterbi decoding takes the path of least cost, the cost of the channel plus
the negative log probability under a letter trigram model of the corpus (26 letters, a boundary and one class for all
others, so a fixed size).

The restored words and their beginnings of 3 to 6 letters are the features of a logistic regression. It is fitted on at
most FIT_ROWS labelled documents, taken by a hash of their ids, and at most FEATURES features, those that set the classes
apart most (chi over Z_LEAST); the letter model and the scores take all texts.

Null texts are empty; the empty text has the score of no feature. Null labels are left out; of several labels of an id the
largest holds. Without labelled rows of both classes every score is 0. Very long texts and tokens are read whole. Repeated
rows each get a row, an empty table stays empty, extra columns pass; those named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, remainder, schema_with, slices, with_columns, written

FIT_ROWS = 50_000
FEATURES = 3_000
Z_LEAST = 5.0
REMEMBERED = 100

#: Letters that a sign or digit resembles.
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
SEPARATORS = "._-~'`*^/\\,:;&%#"

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}  # 0: boundary; 27: any other letter
_N = 28

_PLAIN = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"[\s.\-_\"'(\[{]((?:[^\W_]|[@$!|+(€£¡*#])(?:[\s.\-_]+(?:[^\W_]|[@$!|+(€£¡*#])){2,})(?![^\W_])")  # the character before is a part, as that makes the search fast
_ODD = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*#._\-~'`^/\\,:;&%]+[^\W\d_]|[0-9@$!|+(€£¡][^\W\d_]|([^\W\d_])\1\1")
_EDGES = "\"'`.,;:?!)]}>%&*#~^_-/\\=+([{<"


def _costs(counts: dict[int, int]) -> np.ndarray:
    """Cost (negative natural log) of letter c after a, b, interpolated with the pair and the single letter."""
    c = np.zeros((_N, _N, _N))
    for key, n in counts.items():
        c[key // (_N * _N), key // _N % _N, key % _N] = n
    one = (c.sum((0, 1)) + 1) / (c.sum() + _N)
    two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
    three = (c + 5 * two[None]) / (c.sum(2, keepdims=True) + 5)
    return -np.log(three)


def _tokens(text: str) -> list[str]:
    """The parts between blanks; three or more single characters in a row are one part, with their blanks."""
    out, at, text = [], 0, " " + text
    for m in _SPELLED.finditer(text):
        out += text[at : m.start(1)].split()
        out.append(m[1])
        at = m.end()
    return out + text[at:].split()


def _before(a: tuple, b: tuple) -> bool:
    """Whether path a's text is before path b's; both have as many steps, and only what they do not share is looked at."""
    x, y = [], []
    while a is not b:
        x.append(a[1])
        y.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(x)) < "".join(reversed(y))


class Restorer:
    def __init__(self, counts: dict[int, int]):
        self.cost = _costs(counts).tolist()
        self.words = Memo(self._word, 300_000)

    def _word(self, word: str) -> tuple[str, ...]:
        """The words that a token stands for; one with blanks is spelled out."""
        if word.isalpha() and not _ODD.search(word):
            return (word,)
        core = word.strip(_EDGES)
        core = core if core.isalpha() or any(c.isalpha() for c in core) else word
        if sum(map(str.isalpha, core)) < 2 or not (_ODD.search(core) or _SPELLED.search(" " + core)):
            return tuple(_PLAIN.findall(core))
        return tuple(self.decode(core).split())

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        steps, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and (token[j] == c or c.isspace() and token[j].isspace()):
                j += 1
            run = j - i
            if c.isspace():
                steps.append([("", 0.5), (" ", 0.5)])
            elif c.isalpha():
                options = [(c * run, 0.0 if run < 3 else 3.0 * run)]
                if run > 1:
                    options.append((c, 2.0 if run == 2 else 0.0))
                if run > 2:
                    options.append((c * 2, 0.5))
                steps.append(options)
            else:
                nothing = 0.5 if c in SEPARATORS else 4.0
                options = [("", nothing), (" ", nothing)]
                for x in RESEMBLES.get(c, ""):
                    options.append((x, 1.0))
                    if run > 1:
                        options.append((x * min(run, 2), 1.5))
                steps.append(options)
            i = j
        return steps

    def decode(self, token: str) -> str:
        """The least costly path; of equals the first in alphabetical order."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # a path is (path before, letters)
        for options in self.lattice(token):
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (total, path) in best.items():
                for letters, channel in options:
                    x, y, t = a, b, total + channel
                    for ch in letters:
                        if ch == " ":
                            t += self.cost[x][y][0]
                            x = y = 0
                            continue
                        z = _CODE.get(ch, 27)
                        t += self.cost[x][y][z]
                        x, y = y, z
                    new = (path, letters)
                    known = after.get((x, y))
                    if known is None or t < known[0] or t == known[0] and _before(new, known[1]):
                        after[x, y] = (t, new)
            best = after
        chosen = None
        for (a, b), (t, path) in best.items():
            t += self.cost[a][b][0]
            if chosen is None or t < chosen[0] or t == chosen[0] and _before(path, chosen[1]):
                chosen = (t, path)
        path, out = chosen[1], []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    def restore(self, text: str) -> list[str]:
        """The words of the restored text, lower-cased."""
        short = self.words
        return [w for token in _tokens(text.lower()) for w in (short[token] if len(token) <= REMEMBERED else self._word(token))]

    def vocabulary(self, text: str) -> set[str]:
        short = self.words
        return {w for token in set(_tokens(text.lower())) for w in (short[token] if len(token) <= REMEMBERED else self._word(token))}


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in range(3, 7) if len(word) >= k)]


@dataclass
class Model:
    letters: dict[int, int]
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf

    def scorer(self):
        restorer, weights, bias = Restorer(self.letters), self.weights, self.bias
        of_token = lambda token: tuple({f for w in restorer._word(token) for f in features(w) if f in weights})
        known = Memo(of_token, 400_000)  # most tokens have no feature, so an entry is little more than the token

        def score(text: str) -> float:
            if bias == -math.inf:
                return 0.0
            found = {f for token in set(_tokens(text.lower())) for f in (known[token] if len(token) <= REMEMBERED else of_token(token))}
            z = bias + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

        return score


def letter_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Letter trigrams of all words of letters alone, except letters that are spelled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        words: Counter[str] = Counter()

        def empty() -> None:
            for w, n in words.items():
                if w.isalpha():
                    a = b = 0
                    for ch in w:
                        c = _CODE.get(ch, 27)
                        total[(a * _N + b) * _N + c] += n
                        a, b = b, c
                    total[(a * _N + b) * _N] += n
            words.clear()

        for b in slices(batches):
            for t in b.column(text).to_pylist():
                words.update(_SPELLED.sub(" ", " " + (t or "").lower()).split())
            if len(words) > 150_000:
                empty()
        empty()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    sums = docs.select(text).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in sums.collect()}  # 28**3 rows at most


def _restored(labelled: DataFrame, letters: dict[int, int], text: str) -> DataFrame:
    """(words, __y): the distinct words of each restored text and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(restorer.vocabulary(t or "")) for t in b.column(text).to_pylist()], pa.list_(pa.string())), b.column("__y")], names=["words", "__y"])

    return labelled.mapInArrow(run, "words array<string>, __y int")


def _features_of(restored: DataFrame) -> DataFrame:
    """(feature, ones, zeros): documents with the feature by label, summed for each part of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(sums[0].keys() | sums[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in reversed(sums))], names=["feature", "ones", "zeros"])

        for b in slices(batches):
            for words, y in zip(b.column("words").to_pylist(), b.column("__y").to_pylist(), strict=True):
                sums[y].update({f for w in words for f in features(w)})
            if len(sums[0]) + len(sums[1]) > 150_000:
                yield out()
                for s in sums:
                    s.clear()
        yield out()

    return restored.mapInArrow(run, "feature string, ones bigint, zeros bigint")


def _rows_of(restored: DataFrame, index: dict[str, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Memo(lambda w: tuple(index[f] for f in features(w) if f in index), 400_000)
        for b in slices(batches):
            found = [sorted({i for w in words for i in places[w]}) for words in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column("__y")], names=["x", "y"])

    return restored.mapInArrow(run, "x array<int>, y int")


def _logistic(rows: list[tuple[list[int], int]], n: int, steps: int = 250, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on all rows at once; the rows in a fixed order, so that equal rows give equal weights."""
    rows = sorted(rows)
    at = np.array([i for i, (x, _) in enumerate(rows) for _ in x], np.int64)
    of = np.array([j for x, _ in rows for j in x], np.int64)
    y = np.array([y for _, y in rows], float)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for step in range(1, steps + 1):
        z = np.bincount(at, w[of], len(y)) + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        g = np.append(np.bincount(of, r[at], n) / len(y) + ridge * w[:-1], r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, held_out: int = 5) -> Model:
    """Learns from documents whose remainder of `held_out` is not 0. labels: doc_id and label."""
    learn = docs.filter(remainder(F.col(doc_id), held_out) != 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    letters = letter_counts(learn)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("__y")).filter("doc_id IS NOT NULL AND __y IN (0, 1)")
    known = known.filter(remainder(F.col("doc_id"), held_out) != 0).groupBy("doc_id").agg(F.max("__y").alias("__y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    restored = written(_restored(learn.join(F.broadcast(known), "doc_id").select("text", "__y"), letters, "text"), "restored")  # broadcasts fit_rows ids at most
    sizes = {r["__y"]: r["n"] for r in restored.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(letters)
    sums = _features_of(restored).groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    expected = (F.col("ones") + F.col("zeros")) * (sizes[1] / (sizes[0] + sizes[1]))
    sums = sums.withColumn("z", (F.col("ones") - expected) / F.sqrt(expected)).filter((F.col("ones") + F.col("zeros") >= 4) & (F.abs("z") > Z_LEAST))
    chosen = [r["feature"] for r in sums.orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()]
    rows = [(list(r["x"]), r["y"]) for r in _rows_of(restored, {f: i for i, f in enumerate(chosen)}).collect()]  # fit_rows at most
    w, bias = _logistic(rows, len(chosen))
    return Model(letters, dict(zip(chosen, w.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Adds the score, 0 to 1."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and 28**3 counts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = given.value.scorer()
        for b in slices(batches):
            yield with_columns(b, (), **{column: pa.array([of(t or "") for t in b.column(text).to_pylist()], pa.float64())})

    return docs.mapInArrow(run, schema_with(docs, (), **{column: "double"}))


def restore(docs: DataFrame, model: Model, text: str = "text", column: str = "restored") -> DataFrame:
    """Adds the words of the restored text, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.letters)
        for b in slices(batches):
            yield with_columns(b, (), **{column: pa.array([" ".join(restorer.restore(t or "")) for t in b.column(text).to_pylist()], pa.string())})

    return docs.mapInArrow(run, schema_with(docs, (), **{column: "string"}))
