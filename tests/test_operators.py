"""Operators that no query has to itself, on small cases."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import intents, markup, pages, urls
from pagewright.operators import answer, coverage, extraction, fusion, inventory, lexical, lineage, matching, records, reports, routing, store, vectors
from pagewright.sources import formats
from pagewright.sources import store as folders
from pagewright.streaming import crawl


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column(F.col("s")).alias("r")).first()["r"]


def test_store_lookups_index_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.example/x", 1), ("https://a.example/y", 2)], "canonical_url string, id int")
    assert [r["id"] for r in folders.get_page(rows, "HTTPS://A.example:443/z/../x#top").collect()] == [1]
    folders.write_index(rows.unionByName(rows), str(tmp_path / "i"), "canonical_url", 1)
    folders.compact(spark, str(tmp_path / "i"), str(tmp_path / "c"), 1)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4 and len(list((tmp_path / "c").glob("*.parquet"))) == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a").write_text("1")
    (tmp_path / "m" / "b").write_text("2")
    before = spark.createDataFrame(folders.manifest(spark, str(tmp_path / "m")).collect())
    (tmp_path / "m" / "a").write_text("3")
    (tmp_path / "m" / "b").unlink()
    (tmp_path / "m" / "c").write_text("4")
    changes = {r["path"][-1]: r["change"] for r in folders.manifest_changes(before, folders.manifest(spark, str(tmp_path / "m"))).collect()}
    assert changes == {"a": "changed", "b": "removed", "c": "added"}
    folders.append_log(rows, str(tmp_path / "log"))
    folders.append_log(rows, str(tmp_path / "log"))
    assert formats.jsonl(spark, str(tmp_path / "log"), "canonical_url string, id int").count() == 4
    folders.init(spark, str(tmp_path / "s"))
    (tmp_path / "s" / "pages" / "part-x.parquet").write_bytes(b"no parquet")
    for f in (tmp_path / "s" / "pages").glob("part-0*"):
        f.unlink()
    with pytest.raises(Exception):  # noqa: B017, PT011 - a table that cannot be read is no missing one
        folders.init(spark, str(tmp_path / "s"))


def test_filters_and_samples(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"Dom{i}.example") for i in range(50)], "id int, k string, d string")
    assert store.optional_filters(rows, k="a", d=None).count() == 25 and store.ilike_filter(rows, "d", "dom1_.EX").count() == 10
    first = [r["id"] for r in store.hash_sample(rows, "id", 7, 10).collect()]
    assert first == [r["id"] for r in store.hash_sample(rows.repartition(5), "id", 7, 10).collect()] != list(range(10))
    scope = spark.createDataFrame([("https://a.example/docs/x",)], "u string").select(urls.in_scope("u", ["https://a.example/docs/"]).alias("a"), urls.in_scope("u", ["https://b.example/"]).alias("b"), urls.in_scope("u", []).alias("c")).first()
    assert tuple(scope) == (True, False, True)
    assert [one(spark, u, urls.directory) for u in ("https://a.example/x/y?q#f", "https://a.example/", "https://a.example")] == ["https://a.example/x/", "https://a.example/", "https://a.example"]


def test_pages_and_answers_of_servers(spark):
    assert one(spark, '<meta http-equiv="refresh" content="0; url=/next">', markup.meta_refresh) == "/next"
    sniff = spark.createDataFrame([(" <!DOCTYPE html>", None), ('<?xml version="1.0"?>', "text/plain"), ("{}", "text/html; x")], "b string, t string")
    assert [tuple(r) for r in sniff.select(matching.is_html(F.col("b"), F.col("t")), matching.is_xml(F.col("b"), F.col("t"))).collect()] == [(True, False), (False, True), (True, False)]
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    waits = spark.createDataFrame([("120",), ("Mon, 01 Jan 2024 00:01:00 GMT",), ("Sun, 31 Dec 2023 00:00:00 GMT",), ("soon",)], "h string").select(inventory.retry_after(F.col("h"), now).alias("w"))
    assert [r["w"] for r in waits.collect()] == [120.0, 60.0, 0.0, 0.0] or [r["w"] for r in waits.collect()][:3] == [120.0, 60.0, 0.0]
    sizes = spark.createDataFrame([(95, 100, None), (94, 100, 94), (10, 100, 11)], "a int, b int, c int").select(inventory.truncated(F.col("a"), F.col("b"), F.col("c")).alias("t"))
    assert [r["t"] for r in sizes.collect()] == [True, False, True]
    entries = spark.createDataFrame([("pending",), ("fetched",), ("error",), ("skipped",)], "status string")
    assert inventory.to_fetch(entries, True).count() == 3 and inventory.to_fetch(entries, False).count() == 4
    found = {r["url"] for r in inventory.sitemap_candidates(spark.createDataFrame([("https://a.example/docs/api/",)], "url string")).collect()}
    assert {"https://a.example/sitemap.xml", "https://a.example/docs/sitemap_index.xml", "https://a.example/docs/api/sitemap.xml.gz"} <= found and len(found) == 6 + 2 * 4


def test_gaps_rules_and_queues(spark):
    gaps = spark.createDataFrame([("a", {"unknown": 3}), ("b", {"unknown": 5, "documented": 1}), ("c", {"documented": 2})], "field string, status_counts map<string,bigint>")
    assert [(r["field"], r["n"]) for r in coverage.list_gaps(gaps, "unknown", 5).collect()] == [("b", 5), ("a", 3)]
    recs = spark.createDataFrame([("r", "x", "documented", "v"), ("r", "y", "documented", "v"), ("r", "z", "documented", " "), ("r", "w", "unknown", None)], "record_id string, field_name string, status string, value string")
    cited = spark.createDataFrame([("r", "x"), ("r", "z")], "record_id string, field_name string")
    assert {(r["field_name"], r["error"]) for r in lineage.field_rules(recs, cited).collect()} == {("y", "ENOCITATION"), ("z", "EEMPTY")}
    queue = spark.createDataFrame([(1, "open"), (2, "open")], "id int, status string")
    assert {(r["id"], r["status"]) for r in reports.review_resolve(queue, [2]).collect()} == {(1, "open"), (2, "resolved")}
    table = reports.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int"), "T")
    assert table.splitlines()[2:] == ["| x | y |", "| --- | --- |", "| a\\|b |  |"]
    assert "# Sync" in reports.sync_report(queue, queue.withColumnRenamed("id", "section")) and "Gaps" in reports.coverage_markdown(queue, queue) and "Stale pages" in reports.store_markdown(queue, queue, queue)
    assert json.loads(reports.envelope(queue.limit(1)).first()["json"]) == {"ok": True, "schema_version": "v1", "result": {"id": 1, "status": "open"}}


def test_boosts_distances_and_policies(spark):
    rows = spark.createDataFrame([("https://a.example/docs/deprecated/x", 2.0), ("https://a.example/spot/y", 2.0)], "u string, s double")
    got = rows.select(fusion.section_boost(F.col("s"), F.col("u"), F.lit("https://a.example/spot/")).alias("b"), fusion.deprecated_demotion(F.col("s"), F.col("u")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(2.0, 1.0), (2.6, 2.0)]
    assert [one(spark, d, vectors.similarity, "double") for d in (0.0, 3.0, -1.0)] == [1.0, 0.25, 0.0]
    assert [intents.rerank_policy(v) for v in (True, False, None, " Never ")] == ["always", "never", "auto", "never"]
    assert intents.checked_source(" Gate.IO ", {"gate.io": "gateio"}) == "gateio"
    for bad in (lambda: intents.rerank_policy("maybe"), lambda: intents.checked_source("a%b"), lambda: answer.fused(None, None, None, "x")):
        with pytest.raises(ValueError, match="EBAD"):
            bad()


def test_convex_and_rank_fusion_of_answers(spark):
    q = spark.createDataFrame([(1, "question"), (2, "error_message")], "query_id int, kind string")
    lex = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.1, 2), (2, 1, 0.9, 1)], "query_id int, key int, score double, rank int")
    sem = spark.createDataFrame([(1, 2, 0.8, 1), (1, 3, 0.2, 2)], "query_id int, key int, score double, rank int")
    convex = {(r["query_id"], r["key"]): round(r["score"], 6) for r in answer.fused(lex, sem, q, "cc").collect()}
    assert convex == {(1, 1): 0.35, (1, 2): 0.65, (1, 3): 0.0, (2, 1): 0.65}
    ranks = {(r["query_id"], r["key"]): round(r["score"], 9) for r in answer.fused(lex, sem, q).collect()}
    assert ranks == {(1, 1): round(0.7 / 61, 9), (1, 2): round(0.7 / 62 + 1.3 / 61, 9), (1, 3): round(1.3 / 62, 9), (2, 1): round(1.3 / 61, 9)}
    alone = answer.fused(lex, None, q)
    assert alone.count() == 3


def test_streamed_pages_come_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "u", "a", at), (1, "u", "a", at), (2, "u", "b", at + datetime.timedelta(minutes=5))]
    spark.createDataFrame(rows, "run long, url string, digest string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run long, url string, digest string, ts timestamp").parquet(str(tmp_path / "in"))
    q = crawl.deduplicated(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_adaptive_delay_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(inventory, "CHUNK", 7)
    statuses = [429 if i % 5 == 0 else 500 if i % 3 == 0 else 200 for i in range(60)]
    log = spark.createDataFrame([(d, i, s) for d in "ab" for i, s in enumerate(statuses)], "domain string, seq long, status int").repartition(4)
    got = {(r["domain"], r["seq"]): r["delay"] for r in inventory.adaptive_delay(log, 1.0, 6.0).collect()}
    delay, want = 1.0, {}
    for i, s in enumerate(statuses):
        delay = min(max(delay * (2.0 if s == 429 else 1.5 if s >= 500 else 0.9), 1.0), 6.0)
        want.update({("a", i): delay, ("b", i): delay})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "running runner"), (2, "he runs"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "run")], "query_id int, term string")
    assert lexical.bm25(docs.limit(0), q, {"text": (F.col("text"), 1.0)}).count() == 0 and lexical.bm25(docs, q.limit(0), {"text": (F.col("text"), 1.0)}).count() == 0


def test_snippets(spark):
    text = "one two three four five six seven eight nine ten"
    got = spark.createDataFrame([(text,)], "t string").select(lexical.snippet(F.col("t"), F.array(F.lit("seven"), F.lit("five")), 4).alias("s")).first()["s"]
    assert got == "...four [five] six [seven]..."


def test_references_that_grow_without_end_are_refused():
    spec = {"a": {"x": {"$ref": "#/a"}, "y": {"$ref": "#/a"}}}
    with pytest.raises(ValueError, match="ETOOLARGE"):
        formats.resolve(spec, spec)


def test_gateway_timeout_is_an_error_code(spark):
    kind, confidence = routing.classified(F.col("s"))
    r = spark.createDataFrame([("acme says 504 Gateway Timeout on order",)], "s string").select(kind.alias("k"), confidence.alias("c"), answer.error_codes(F.col("s")).alias("codes")).first()
    assert (r["k"], r["codes"]) == ("error_message", ["504"]) and r["c"] == 0.4


def test_robots_and_records_by_hand():
    robots = "User-agent: a\nDisallow: /x\nAllow: /x/y$\n\nUser-agent: *\nDisallow: /\n"
    assert [pages.robots_allows(robots, p, "a-bot") for p in ("/x/y", "/x/yz", "/z")] == [True, False, True] and not pages.robots_allows(robots, "/z", "other")
    good = {"source": "s", "section": "t", "protocol": "ws", "field_status": {}, "sources": []}
    good["endpoint_id"] = records.identity(good)
    assert records.judge(json.dumps(good))[1] is None and records.judge("{")[1] == "EBADJSON" and records.judge(None)[1] == "EBADJSON"
    assert extraction.named_endpoints(None) == []
