"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, decontam, line_dedup, periodic, product_codes, secret_scan, sharding, simhash, suffix_lm, token_counts, toxicity, url_filter
from .common import remainder, table, written


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.default_ranks(spark)
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, token_counts.default_definition(spark))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = avi.write_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = avi.read_media(stored)
    tail = F.substring("payload", -64, 64)
    return read.select("doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates go by their digests, so that no secret is spread further."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    words = written(secret_scan.dictionary(docs), "dictionary")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.findings(spark), words), path="source", words=words)
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.judged(decontam.find_items(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    scored = suffix_lm.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _repeated(text: Column, doc_id: Column) -> Column:
    """Where crc32 of the id ends in 0, the text's words with a part of them repeated in place of those after it; else the text."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, n)
    most = 3 + F.pmod(g, F.lit(8))
    p = 1 + F.floor((n - a) / most)
    part = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), 11))  # p * 10 words or fewer are wanted
    again = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(part, F.lit(1), (n - a).cast("int")))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(again, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeated(F.col("text"), F.col("doc_id")).alias("text"))
    r = lambda c: F.col(f"longest.{c}")
    each = F.transform("runs", lambda x: F.concat_ws("", F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return periodic.periodic_runs(docs).select(
        "doc_id", "n_runs", r("start").alias("start"), r("length").alias("length"), r("period").alias("period"), F.expr("1000 * longest.length DIV longest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", each), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = product_codes.product_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_url_filter, op3_token_counts, op4_secret_scan, op5_toxicity, op6_decontamination, op7_simhash, op8_suffix_tree_lm, op9_avi_media, op10_line_dedup, op11_periodic_runs, op12_sharding, op13_product_codes)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g), p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n),
h AS (SELECT DISTINCT doc_id, item_id, i, g.n FROM p JOIN g ON g.n = p.n AND g.gram = array_to_string(w[i : i + p.n - 1], ' ')),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: they need a tokeniser, a hash, a media format or a fitted model; tests hold them against brute force."""
    return {"op2_url_filter": url_filter.sql(), "op6_decontamination": OP6_SQL, "op13_product_codes": product_codes.sql()}
