"""Every operator on rows that are empty, very long, repeated, without an id, or named like a result, and on empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontam, secret_scan, simhash, token_counts, url_filter

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", " ", "same text here", "same text here", LONG]
IDS = [None, 1, 2, 3, 3, 4]
CLASHES = ["n_tokens", "ids", "decoded", "n_bytes", "spans", "n_words", "probability", "prediction", "rawPrediction", "is_secret", "start", "host", "score", "fp", "component_id"]


def docs(spark, texts=TEXTS, ids=IDS):
    schema = "doc_id long, text string, extra string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, f"e{k}", *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], schema)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def test_bpe(spark, vocabulary):
    rows = sorted(bpe.round_trip(docs(spark), *vocabulary).collect(), key=lambda r: r["extra"])
    assert [bytes(r["decoded"]).decode() for r in rows] == [t or "" for t in TEXTS] and rows[3]["ids"] == rows[4]["ids"] and rows[0]["n_tokens"] == 0
    assert bpe.round_trip(docs(spark, [], []), *vocabulary).count() == 0


def test_token_counts(spark):
    definition = token_counts.default_definition(spark)
    rows = sorted(token_counts.token_counts(docs(spark), definition).collect(), key=lambda r: r["extra"])
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in TEXTS] and rows[3]["n_tokens"] == rows[4]["n_tokens"] > 0 == rows[0]["n_tokens"]
    assert token_counts.token_counts(docs(spark, [], []), definition).count() == 0


def test_secrets(spark):
    model = secret_scan.train(secret_scan.findings(spark, 1_200))
    secret = hashlib.sha1(b"z").hexdigest()
    texts = [None, "", f'token = "{secret}"', f'token = "{secret}"', "a" * 200_000, "filler words " * 20_000 + f'token = "{secret}"']
    found = secret_scan.scan(docs(spark, texts), model)
    rows = found.collect()
    assert sorted(r["extra"] for r in rows) == ["e2", "e3", "e5"] and all(r["is_secret"] and r["prediction"] == r["rawPrediction"] == "clash" and 0 <= r["probability"] <= 1 for r in rows)
    assert [r["start"] for r in rows if r["extra"] == "e5"] == [len("filler words ") * 20_000 + 9]
    assert secret_scan.scan(docs(spark, [], []), model).count() == 0
    # a fixture by hand: shares, changes and neighbouring words
    one = spark.createDataFrame([("aB3-xyz00", 'the token = "', '" and'), ("sha", "commit ", "")], "candidate string, before string, after string")
    f = {r["candidate"]: r for r in secret_scan.featured(one).collect()}
    r = f["aB3-xyz00"]
    assert (r["f_length"], r["f_secret_word"], r["f_harmless_word"], r["f_assigned"], r["f_quoted"]) == (9, 1, 0, 1, 1)
    assert (round(r["f_digit"] * 9), round(r["f_upper"] * 9), round(r["f_lower"] * 9), round(r["f_hex"] * 9), round(r["f_changes"] * 9)) == (3, 1, 4, 4, 3)
    assert f["sha"]["f_harmless_word"] == 1 and f["sha"]["f_secret_word"] == 0


def test_decontamination(spark):
    items = spark.createDataFrame([("a", "same text here"), ("a", "same text here"), ("b", None), ("c", "")], "item_id string, text string")
    rows = sorted(decontam.judged(decontam.find_items(docs(spark), items)).collect(), key=lambda r: r["extra"])
    assert [r["contaminated"] for r in rows] == [False, False, False, True, True, False] and rows[3]["n_words"] == 3 and rows[5]["n_words"] == 60_000
    assert decontam.find_items(docs(spark), items.limit(0)).count() == len(TEXTS) and decontam.find_items(docs(spark, [], []), items).count() == 0


def test_items_longer_than_a_block(spark):
    ws = [f"w{i}" for i in range(130)]
    items = spark.createDataFrame([("long", " ".join(ws)), ("short", "w3 w4")], "item_id string, text string")
    texts = [" ".join(ws[20:40]), " ".join(ws), "x " + " ".join(ws[47:60]), " ".join(ws[3:14])]
    got = {}
    for block in (400_000, 40, 13):
        rows = decontam.judged(decontam.find_items(docs(spark, texts, range(4)), items, block_words=block)).collect()
        got[block] = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows)
    assert got[400_000] == got[40] == got[13] and [r[2] for r in got[40]] == [20, 130, 13, 2]


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(docs(spark)).collect()
    assert len(rows) == len(TEXTS) and {r["component_id"] for r in rows if r["doc_id"] == 3} == {3}
    assert simhash.near_duplicates(docs(spark, [], [])).count() == 0
    kept = simhash.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns and kept.filter("doc_id = 3").count() == 1


def test_urls(spark):
    long = "http://long.example/" + "a/" * 20_000
    pages = docs(spark, [None, "", "no scheme", "http://a.example/x", "http://a.example/x", long])
    rows = sorted(url_filter.filter_urls(pages, "text").collect(), key=lambda r: r["extra"])
    assert [r["verdict"] for r in rows] == ["allow"] * 6 and rows[5]["host"] == "long.example" and len(rows[5]["path"]) == 40_001
    own = url_filter.filter_urls(pages.withColumn("bad", F.col("doc_id") == 4), "text", rejected=F.col("bad"))
    assert own.count() == 6 and url_filter.filter_urls(pages.limit(0), "text").count() == 0


def test_folders_are_deleted_but_for_what_is_kept(spark):
    from pagewright.llm import common

    d = docs(spark)
    first = common.written(d, "first")
    since = len(common.made(spark))
    a, b = common.written(d, "a"), common.written(d, "b")
    common.clean(spark, b, since=since)
    assert len(common.made(spark)) == since + 1 and b.count() == first.count() == len(TEXTS)
    with pytest.raises(Exception):  # noqa: B017, PT011 - its files are gone
        a.collect()
    common.clean(spark, first)
    assert len(common.made(spark)) == 1 and first.count() == len(TEXTS)
