"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

A-Z is lower-cased, words are runs of digits, letters a-z and everything outside ASCII. An item's windows are its runs of
13 words; a shorter item is one window. Each word of the items is one letter of the automaton's alphabet, each other word
a letter that no window has, so a document is scanned once, a word at a time; word positions are mapped to the original
text's offsets where something was found.

Items are read in blocks of at most BLOCK_WORDS words, so what a worker holds is bounded; usually there is one block. A
longer item is cut into pieces that share WINDOW - 1 words; its spans are then joined within a piece only.
Null texts have no words; very long ones are scanned whole. A null item_id counts as the empty string; items that repeat an
id are one. Repeated rows each get a row; an empty table stays empty, and without items nothing is found. Extra columns
pass; those named like a result are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import schema_with, slices, with_columns, written

WINDOW = 13
#: Words of the items that one automaton takes; further items go to another one.
BLOCK_WORDS = 400_000

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SPAN = "struct<item_id:string,first_word:int,last_word:int,start:int,end:int>"
_SPAN_TYPE = pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_FOREIGN = "\x01"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def _letter(i: int) -> str:
    """The i-th letter of the automaton's alphabet: code points from 256 on, without surrogates."""
    return chr(i + 256 if i + 256 < 0xD800 else i + 256 + 0x800)


class Automaton:
    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        found: dict[str, list[str]] = {}
        for item_id, text in items:
            ws = words(text)
            coded = "".join(self.letters.setdefault(w, _letter(len(self.letters))) for w in ws)
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                found.setdefault(coded[i : i + window], []).append(item_id)
        self.automaton = ahocorasick.Automaton()
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key), tuple(dict.fromkeys(ids))))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def spans(self, ws: list[bytes]) -> list[tuple[str, int, int]]:
        """(item, first word, last word), overlapping and adjoining windows of an item joined."""
        if self.empty or not ws:
            return []
        get, found = self.letters.get, {}
        for last, (n, ids) in self.automaton.iter("".join([get(w, _FOREIGN) for w in ws])):
            for item in ids:
                runs = found.setdefault(item, [])
                first = last - n + 1
                while runs and runs[-1][1] >= first - 1:  # windows come by their ends; a longer one may reach behind earlier ones
                    first = min(first, runs.pop()[0])
                runs.append((first, last))
        return [(item, a, b) for item, runs in sorted(found.items()) for a, b in runs]


def _pieces(text: str | None, window: int, most: int) -> Iterator[tuple[str | None, int]]:
    """The item's text with its number of words; one of more than `most` words in pieces that share window - 1 words, so that each window is in one of them."""
    ws = words(text)
    if len(ws) <= max(most, window):
        yield text, len(ws)
        return
    step = max(1, most - window + 1)
    for i in range(0, len(ws) - window + 1, step):
        part = ws[i : i + step + window - 1]
        yield b" ".join(part).decode(), len(part)


_built: dict[str, Automaton] = {}


def _scan(docs: DataFrame, items: list[tuple[str, str | None]], window: int, text: str) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words
    key = uuid.uuid4().hex  # what a reused worker tells automata apart by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(given.value, window)
        automaton = _built[key]
        for b in slices(batches):
            counts, spans = [], []
            before = b.column("spans").to_pylist() if "spans" in b.schema.names else [[]] * b.num_rows
            for t, old in zip(b.column(text).to_pylist(), before, strict=True):
                ws = words(t)
                counts.append(len(ws))
                found = automaton.spans(ws)
                if found:
                    at = [m.span() for m in _WORD.finditer(t)]
                    old = old + [{"item_id": i, "first_word": x, "last_word": y, "start": at[x][0], "end": at[y][1]} for i, x, y in found]
                spans.append(old)
            yield with_columns(b, (), n_words=pa.array(counts, pa.int64()), spans=pa.array(spans, _SPAN_TYPE))

    return docs.mapInArrow(run, schema_with(docs, (), n_words="bigint", spans=f"array<{_SPAN}>"))


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words long and spans: where windows of items occur, by word (from 0) and by character [start, end)."""
    out, block, size = docs.drop("n_words", "spans"), [], 0
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(item_text).cast("string"))
    several = False
    for item in items.toLocalIterator():  # a partition of the items at a time
        for part, n in _pieces(item[1], window, block_words):
            if block and size + n > block_words:
                out, block, size, several = written(_scan(out, block, window, text), "decontamination"), [], 0, True
            block.append((item[0], part))
            size += n
    out = _scan(out, block, window, text)
    return written(out, "decontamination") if several else out


def n_hit(spans: str = "spans") -> Column:
    """Words inside any span."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["last_word"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), s["last_word"] - F.greatest(s["first_word"], acc["end"] + 1) + 1)).alias("n"),
    )
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first_word"].alias("first_word"), s["last_word"].alias("last_word"))))
    return F.aggregate(ordered, F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n")), step, lambda acc: acc["n"])


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items (sorted ids) and contaminated to what find_items() gives."""
    found = found.withColumn("n_hit", n_hit()).withColumn("items", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"]))))
    return found.withColumn("n_items", F.size("items").cast("bigint")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
