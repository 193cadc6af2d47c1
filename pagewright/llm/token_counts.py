"""Token counts through a digest cache.

A row's key is the SHA-256 of its normalised content with the tokenizer's own digest (its version). Keys that the cache
table lacks are the misses; one text of each is encoded and its count appended to the cache; all rows then take their count
by a join on the key. Normalisation turns every run of blanks, tabs and line ends into one blank: white space is dropped by
the tokenizer's pre-split, so texts that differ in it alone have equal counts.

Texts move once, by key, after copies within a partition have been dropped, so a group of many copies is one row per map
task. Within a worker, equal words are encoded once (a bounded cache); words are cut at ASCII white space, where neither
the normaliser nor the pre-split nor a special string reaches across.

Null texts count as empty: 0 bytes, 0 tokens. Very long texts are encoded whole. Repeated rows each get a row; an empty
table stays empty. Extra columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shared_folder, slices, whole_text, written

KEY, TEXT = "__digest", "__text"
_FOLD = str.maketrans(UPPER, LOWER)


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _parts(word: str) -> tuple[str, ...]:
    """The word, or its letters and the punctuation at its end apart, which the pre-split parts anyhow; A-Z as a-z, as the normaliser does. Only after a Latin letter, which stays one letter when normalised. Words that may hold a special string stay as they are."""
    if "<" in word or "|" in word:
        return (word,)
    word = word.translate(_FOLD)
    core = word.rstrip(".,!?;:*&%$#")
    last = core[-1:]
    return (core, word[len(core) :]) if len(core) < len(word) and last.isalpha() and last < "\u0250" and last != "\u0130" else (word,)


@lru_cache(maxsize=1)
def _counter(definition: bytes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    known: dict[bytes, int] = {}
    parts: dict[str, int] = {}
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def count(texts: list[str]) -> list[int]:
        split = [t.encode().split() for t in texts]
        if len(known) > 500_000:
            known.clear()
        if len(parts) > 500_000:
            parts.clear()
        new = {w: _parts(w.decode()) for w in {w for words in split for w in words if w not in known}}
        missing = list({p for ps in new.values() for p in ps if p not in parts})
        for i in range(0, len(missing), 4096):
            some = missing[i : i + 4096]
            parts.update(zip(some, map(len, encode(some, add_special_tokens=False)), strict=True))
        for w, ps in new.items():
            known[w] = sum(parts[p] for p in ps)
        return [sum(map(known.__getitem__, words)) for words in split]

    return count


def digest(definition: bytes, text: Column) -> Column:
    version = hashlib.sha256(definition).hexdigest()
    return F.unhex(F.sha2(F.concat(F.lit(version + ":"), F.regexp_replace(text, r"[ \t\n\r]+", " ")), 256))


def _once(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Drops rows whose key this partition has had; after `limit` keys it starts anew, which only lets copies through."""
    seen: set[bytes] = set()
    for b in batches:
        keys, keep = b.column(KEY).to_pylist(), []
        for k in keys:
            keep.append(k not in seen)
            seen.add(k)
        if len(seen) > limit:
            seen.clear()
        yield b.filter(pa.array(keep, pa.bool_()))


def count_misses(missing: DataFrame, definition: bytes) -> DataFrame:
    """(key, text) dealt by key, copies included, to (key, n_tokens) with each key once."""
    given = missing.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(given.value)
        for b in slices(_once(batches)):
            yield pa.RecordBatch.from_arrays([b.column(KEY), pa.array(count(b.column(TEXT).to_pylist()), pa.int64())], names=[KEY, "n_tokens"])

    return missing.mapInArrow(run, f"{KEY} binary, n_tokens bigint")


def token_counts(docs: DataFrame, definition: bytes, cache: str | None = None, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes long and n_tokens long.

    cache: path of the cache table (a folder of Parquet files, appended to); by default a new one in the shared folder.
    Two runs that append at once may store a key twice; readers take one of the equal rows.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_folder(spark)}/pagewright-token-cache-{uuid.uuid4().hex}"
    schema = f"{KEY} binary, n_tokens bigint"
    keyed = docs.withColumn(TEXT, whole_text(text)).withColumn(KEY, digest(definition, F.col(TEXT)))
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # so that the folder can be read
    texts = keyed.select(KEY, TEXT).mapInArrow(_once, f"{KEY} binary, {TEXT} string").repartition(KEY)
    stored = spark.read.schema(schema).parquet(cache).select(KEY)
    misses = texts.join(stored, KEY, "left_anti") if stored.take(1) else texts
    count_misses(misses, definition).write.mode("append").parquet(cache)
    # written, so that the join below has two plain sides and a frequent digest can be split
    counts = written(spark.read.schema(schema).parquet(cache).groupBy(KEY).agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    out = keyed.drop("n_tokens", "n_bytes").withColumn("n_bytes", F.octet_length(TEXT).cast("bigint")).drop(TEXT, text)
    return out.join(counts, KEY).drop(KEY)


def default_definition(spark: SparkSession) -> bytes:
    import public_tokenizers

    return read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
