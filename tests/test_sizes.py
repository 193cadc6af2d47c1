"""Cases that larger tables bring: long sitemaps, URLs that several pages share, codes in other sources' pages."""

import time

import __spark_entry__
import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import answer, evaluation, inventory, routing, vector_index, vectors
from pagewright.sources import formats


def test_sitemap_of_many_entries_is_searched_once(spark):
    urls = "".join(f"<url><loc>https://a.example/docs/page/{i}</loc></url>" for i in range(20_000))
    loop = "<sitemapindex><sitemap><loc>https://a.example/i.xml</loc></sitemap><sitemap><loc>https://a.example/m.xml</loc></sitemap></sitemapindex>"
    rows = [("https://a.example/i.xml", 200, "text/xml", loop.encode()), ("https://a.example/m.xml", 200, "text/xml", f"<urlset>{urls}</urlset>".encode())]
    began = time.monotonic()
    found, errors = inventory.sitemap_walk(spark.createDataFrame(rows, "url string, status int, content_type string, body binary"), spark.createDataFrame([("https://a.example/i.xml",)], "url string"))
    assert (found.count(), errors.count()) == (20_000, 0)
    assert time.monotonic() - began < 60  # minutes where each entry searched the whole sitemap again


def _pages(spark, tmp_path):
    """Pages 0 to 11 with the URLs of 0 to 3."""
    spark.range(12).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/en/"), (F.col("id") % 4).cast("string")).alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_backfill_of_pages_with_one_url(spark, tmp_path):
    rows = __spark_entry__.queries()["inventory_backfill"](spark, _pages(spark, tmp_path)).collect()
    assert sorted(r["url"] for r in rows) == sorted(f"https://a.example/en/{i % 4}" for i in range(12) if i % 3)


def test_recount_of_pages_with_one_url(spark, tmp_path):
    assert [tuple(r) for r in __spark_entry__.queries()["inventory_recount"](spark, _pages(spark, tmp_path)).collect()] == [(2, 12)]


def test_owners_of_pages_with_one_url(spark, tmp_path):
    rows = __spark_entry__.queries()["owned_pages"](spark, _pages(spark, tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted([(i, "owner" if i % 3 == 0 else "english") for i in range(12)] + [(0, "second"), (6, "second")])


def test_a_code_in_another_sources_page_is_undocumented(spark):
    questions = spark.createDataFrame([(1, "acme error -4242"), (2, "acme error -1013")], "query_id int, question string")
    docs = spark.createDataFrame([(1, "acme", "spot", "https://acme.example/errors", "Error -1013: a filter."), (2, "web", "x", "https://web.example/2", "4242 words")], "doc_id bigint, source string, section string, url string, text string")
    registry = spark.createDataFrame([(1, "acme", "Acme", ["spot"]), (2, "web", "Web", ["x"])], "ord int, source string, name string, sections array<string>")
    known = spark.createDataFrame([("r", "acme", "spot", "GET", "/x", "X", None)], "record_id string, source string, section string, method string, path string, text string, docs_url string")
    rows = {r["query_id"]: r for r in answer.answers(questions, docs, registry, known).collect()}
    assert (rows[1]["status"], rows[1]["claims"]) == ("undocumented", None) and [c["doc_id"] for c in rows[2]["claims"]] == ["1"]


def test_settings_of_an_index_hold_the_neighbours_of_vectors_without_clusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4_000, 128)))], "vec_id bigint, embedding array<double>").cache()
    root, asked = str(tmp_path / "i"), rows.filter("vec_id % 50 = 0")
    vector_index.add(rows, root)
    probes, candidates = vector_index.settings_for(spark, root, rows, rows.filter("vec_id % 50 = 25"), 10)
    share = lambda c: vector_index.recall(vector_index.search(spark, root, asked, 10, probes, c), rows, asked, 10).first()["recall"]
    assert candidates > 10 and share(candidates) >= 0.9 > share(10)


def test_sources_of_a_long_text_are_looked_up_in_it(spark):
    long = "Alpha  store, " + " ".join(f"w{i}x" for i in range(40_000)) + " BETA"
    asked = spark.createDataFrame([(1, long), (2, "alphabet store"), (3, None), (4, "beta and gamma-ray")], "id int, s string")
    registry = spark.createDataFrame([(1, "a", "Alpha Store"), (2, "beta", "Beta"), (3, "g", "Gamma Ray")], "ord int, source string, name string")
    found = routing.detected_sources(asked, registry, "id", "s")
    assert {r["id"]: r["sources"] for r in found.collect()} == {1: ["a", "beta"], 4: ["beta", "g"]}
    assert "__s" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row a word that carries the whole text


def test_specs_of_one_file_are_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(i, f"openapi: 3.0.0\npaths:\n  /a{i}:\n    get:\n      summary: x\n") for i in range(40)], "file int, content string").coalesce(1)
    rows = formats.import_specs(files)
    assert rows.rdd.getNumPartitions() > 1 and sorted(r["path"] for r in rows.collect()) == sorted(f"/a{i}" for i in range(40))


def test_relevance_by_label_equals_pairs(spark):
    keys = spark.createDataFrame([(i, (None if i == 7 else i % 3), 1 + i % 2) for i in range(14)], "key bigint, label int, relevance int")
    queries = keys.filter("key % 2 = 1").select(F.col("key").alias("query_id"))
    ranked = spark.createDataFrame([(q, (q * 5 + r) % 14, r) for q in range(1, 14, 2) for r in range(1, 8)], "query_id bigint, key bigint, rank int").filter("query_id <> key")
    asked = queries.join(keys.select(F.col("key").alias("query_id"), "label"), "query_id")
    pairs = asked.join(keys, "label").filter("query_id <> key").select("query_id", "key", "relevance")
    of = evaluation.Labelled(keys)
    for metric in (evaluation.mrr, lambda *x: evaluation.hit_and_recall(*x, 3), lambda *x: evaluation.ndcg(*x, 5)):
        assert sorted(map(tuple, metric(queries, ranked, of).collect())) == sorted(map(tuple, metric(queries, ranked, pairs).collect()))


def test_more_queries_than_are_multiplied_at_once(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((2 * vectors.AT_ONCE + 9, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in vectors.knn(rows, rows, 1).collect()}
    d = ((m[:, None] - m[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == set(enumerate(d.argmin(1).tolist()))


def test_a_sweep_sorts_a_key_once(spark):
    """Each key once for all alphas, so a task's memory has no factor of their number; nulls of two lists are not equal."""
    alphas = (0.0, 0.3, 0.7, 1.0)
    lexical = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (2, "c", 0.4), (2, None, 0.3), (None, "a", 0.9), (3, "x", None)], "query_id int, key string, l double")
    semantic = spark.createDataFrame([(1, "b", 1.0), (1, "c", 0.9), (2, "d", 0.4), (2, None, 0.6), (None, "b", 0.2)], "query_id int, key string, s double")
    found = evaluation.alpha_sweep(lexical, semantic, alphas, 5)
    pairs = lexical.join(semantic, ["query_id", "key"], "full").collect()
    want = {}
    for a in alphas:
        for q, k, l, s in pairs:
            best = (round(a * (l or 0.0) + (1 - a) * (s or 0.0), 6), k is not None, k or "")
            want[a, q] = max(want.get((a, q), best), best)
    assert {(r["alpha"], r["query_id"]): r["best"] for r in found.collect()} == {at: best[2] or None for at, best in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("max_by") and "Join" not in plan  # the mixtures are rows of their own after the keys are judged, not before


def test_lists_are_dealt_by_the_rows_of_their_table(spark, tmp_path, monkeypatch):
    from pagewright.plans import retrieval_queries

    spark.range(2_000).selectExpr("id % 50 AS l_partkey", "id % 7 AS l_suppkey", "double(id) AS l_extendedprice", "double(id % 50) AS l_quantity", "'N' AS l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(retrieval_queries, "_LINES", 100)
    assert retrieval_queries._side(spark, str(tmp_path), True).rdd.getNumPartitions() == 20


def test_a_path_is_worked_out_once(spark):
    from pagewright.functions import urls

    given = ["", "/", "\n", None, "/a/:id/", "https://h.example", "{{url}}/v1/<p>?x=1", "https://h.example/?q", "/a/{b}/c)."]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string").select("i", urls.normalized_api_path("s").alias("path"), urls.path_for_dedup("s").alias("dedup"))
    assert [(r["path"], r["dedup"]) for r in rows.orderBy("i").collect()] == [
        ("/", "/"), ("/", "/"), ("\n", "\n"), (None, None), ("/a/{id}", "/a/{}"), ("https://h.example", "/"), ("{{url}}/v1/{p}", "/v1/{}"), ("https://h.example", "/"), ("/a/{b}/c", "/a/{}/c"),
    ]
    plan = rows.select("dedup")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 12  # more than thirty where a condition held the path on both its sides


def test_records_of_parts_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    from pagewright.plans import answer_queries

    spark.range(900).selectExpr("id AS p_partkey", "'b' AS p_brand", "'n' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(answer_queries, "_RECORDS_OF_PART", 100)
    assert answer_queries._parts(spark, str(tmp_path)).rdd.getNumPartitions() == 9


def test_percentiles_of_a_group_are_found_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501).tolist(), "b": [7.0] * 300 + [8.5], None: [3.0, None, 1.0], "one": [4.0], "none": [None, None]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    at = {"low": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "top": 1.0}
    found = evaluation.percentiles(rows, ["g"], "v", at, 9)
    got = {r["g"]: tuple(r[n] for n in at) for r in found.collect()}
    assert got.keys() == groups.keys() and got["none"] == (None,) * 5
    for g, vs in groups.items():
        if g != "none":
            assert np.allclose(got[g], np.quantile([v for v in vs if v is not None], list(at.values())), rtol=1e-12, atol=0)
    rows.filter("g = 'a'").selectExpr("g AS l_returnflag", "v AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = __spark_entry__.queries()["percentiles"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan  # that aggregate gives a whole group's values to one task
    empty = evaluation.percentiles(rows.limit(0), ["g"], "v", at, 3)
    assert empty.columns == ["g", *at] and empty.count() == 0


def test_records_are_built_in_partitions_of_few_rows(spark, tmp_path, monkeypatch):
    from pagewright.operators import records
    from pagewright.plans import record_queries

    spark.range(600).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "'b' AS p_brand", "int(id % 50) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(record_queries, "_RECORDS", 100)
    assert [df.rdd.getNumPartitions() for df in record_queries._built(spark, str(tmp_path))] == [6, 6]
    rows = {r["field_name"]: (r["n"], r["n_urls"]) for r in record_queries.record_lineage(spark, str(tmp_path)).collect()}
    assert rows == {**dict.fromkeys(("http.method", "http.path", "http.base_url", "description"), (600, 600)), "rate_limit": (288, 288)}
    cited = spark.createDataFrame([("f", "u"), ("f", "u"), ("f", None), ("g", "u"), ("h", None)], "field_name string, doc_url string")
    assert sorted(map(tuple, records.field_counts(cited, 3).collect())) == [("f", 3, 1), ("g", 1, 1), ("h", 1, 0)]
