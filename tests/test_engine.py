"""Functions and operators on small cases, and every registered query against its SQL."""

import gzip
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewright.functions import markup, text, urls
from pagewright.operators import batching, evaluation, extraction, fusion, inventory, lexical, lineage, routing, store
from pagewright.plans import catalog
from pagewright.sources import commits, formats
from pagewright.sources import store as folders
from pagewright.streaming import crawl

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column(F.col("s")).alias("r")).first()["r"]


def _plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    where = [list(rel.columns).index(c) for c in columns]
    assert sorted(tuple(_plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in where) for r in rel.fetchall()) == rows


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://User:pw@Host.Example:80/a/../b/./c/?q=A#f", "http://host.example/b/c/?q=A"), ("host.example", "https:///host.example"), ("https://h.example", "https://h.example/"),
    ("https://h.example:444/x", "https://h.example:444/x"), ("https://h.example/../../x", "https://h.example/x"), (None, None),
])
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical, url) == want


def test_canonical_url_is_idempotent(spark):
    rows = spark.createDataFrame([("https://a.example/b//c/..",), ("HTTPS://A.example/?x=%41",), ("https://a.example/ü",)], "u string")
    once = rows.select(urls.canonical("u").alias("u"))
    assert once.collect() == once.select(urls.canonical("u").alias("u")).collect()


@pytest.mark.parametrize(("value", "want"), [("\x00x", "control_chars"), ("x" * 5000, "too_long"), ("https://[bad/x", "unparseable"), ("/relative/path", None), (None, "empty")])
def test_url_rejection(spark, value, want):
    assert one(spark, urls.rejection, value) == want


def test_words_of_null_and_unicode(spark):
    assert one(spark, text.word_count, " a b \n c ") in (2, 3)
    assert one(spark, text.tokens, "Über-café 한국어 x1") == ["über", "café", "한국어", "x1"]
    assert one(spark, text.search_terms, "How does the WebSocket auth work?") == ["websocket", "auth", "work", "wss", "authentication"][:3] + ["ws", "wss", "authentication"]


def test_markdown_of_html():
    md = markup.to_markdown("<html><head><title>x</title></head><body><h1>T</h1><p>a <a href='/u'>l</a></p><pre>c\n d</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2|3</td></tr></table></body></html>")
    assert md.split("\n\n") == ["# T", "a [l](/u)", "```\nc\n d\n```", "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"]
    assert markup.to_markdown(None) is None and markup.to_markdown("") == ""


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("agreed", "agre"), ("happy", "happi"), ("sky", "sky"), ("adjustment", "adjust"), ("controlling", "control")])
def test_stem(word, want):
    assert lexical.stem(word) == want


def test_stemmed_column(spark):
    assert one(spark, lexical.stemmed, ["running", "runs"], "array<string>") == ["run", "run"]


def test_chunks_cover_the_text_and_keep_fences():
    md = "# A\n" + "word " * 700 + "\n\n```\n" + "code\n" * 200 + "```\n\n## B\n" + "x" * 5000
    chunks = extraction.chunk_markdown(md)
    covered = set()
    for a, b, _, _ in chunks:
        covered |= set(range(a, b))
    assert not [i for i, c in enumerate(md) if i not in covered and c.strip()]
    assert any(md[a:b].count("```") == 2 for a, b, _, _ in chunks)
    assert extraction.chunk_markdown("  ") == [] and len(extraction.chunk_markdown("short")) == 1


def test_parameters_of_all_tables_of_a_section():
    md = "# Order\n## GET /a\n### Request\n|Name|Type|\n|--|--|\n|a|INT|\n|-b|INT|\n|--c|INT|\n|-d|INT|\n\n#### a\n|Name|Type|\n|--|--|\n|e|INT|\n\n|x|y|\n|--|--|\n|1|2|\n### Response\n|Name|Type|\n|--|--|\n|r|INT|\n"
    got = [(p["name"], p["parent"], p["table"]) for p in extraction.parameters_near(md, md.index("## GET"))]
    assert got == [("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("d", "a", 1), ("e", "a", 2)]
    assert extraction.parameters_near(None) == extraction.parameters_near("# Request\ntext") == extraction.parameters_near("no heading |a|b|") == []
    assert [p["name"] for p in extraction.parameters_near(md, len(md))] == ["a", "b", "c", "d", "e"]
    assert extraction.parameters_near("## Params\n" + md, 20_000) == [] and [p["name"] for p in extraction.parameters(md)] == ["a", "b", "c", "d"]


def test_navigation_by_lines():
    from pagewright.functions.pages import Layout

    menu = "\n".join(f"* entry {i}" for i in range(20))
    text = "\n".join(f"A sentence number {i} that says something." for i in range(60))
    page = Layout(menu + "\n" + text)
    assert page.is_navigation(0) and not page.is_navigation(len(menu) + 1500) and not Layout("").is_navigation(0) and not Layout("* a\n* b\n* c").is_navigation(0)
    for line, want in (("[a](b)", True), ("EN | DE | FR", True), ("| a | b |", False), ("# A | B", False), ("see [a](b) and [c](d) here", True), ("* " + "x" * 140, False), ("plain text", False)):
        assert Layout("\n".join([line] * 5)).is_navigation(0) == want
    assert Layout("x\nSkip to content\n").is_navigation(0)


def test_rrf_does_not_depend_on_order(spark):
    rows = [(1, 1, "a", 1, 1.0), (1, 1, "b", 2, 1.0), (1, 2, "b", 1, 1.0), (1, 2, "", 2, 1.0), (1, 2, None, 3, 1.0)]
    ddl = "query_id int, list_id int, key string, rank int, weight double"
    a, b = (sorted(fusion.rrf(spark.createDataFrame(r, ddl)).collect()) for r in (rows, rows[::-1]))
    assert a == b and len(a) == 2


def test_bm25_rises_with_term_frequency(spark):
    docs = spark.createDataFrame([(1, "x y y y"), (2, "x x y y"), (3, "y y y y"), (4, None)], "doc_id long, text string")
    scored = lexical.bm25(docs, spark.createDataFrame([(1, "x")], "query_id int, term string"), {"text": (F.col("text"), 1.0)})
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert set(got) == {1, 2} and got[2] > got[1]


def test_insert_or_ignore_and_diff_of_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert [tuple(r) for r in store.insert_or_ignore(empty, new, ["k"]).collect()] == [(1, "a")]
    assert tuple(store.inventory_diff(empty.select("k"), new.select("k")).first()) == (1, 0, 0)
    assert store.set_overlap(empty.select("k"), empty.select("k")).first()["coverage_pct"] == 100.0


def test_upsert_keeps_and_counts_previous(spark):
    ddl = "url string, digest string, run long"
    got = lineage.page_upsert(spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], ddl), spark.createDataFrame([("b", "2", 2), ("b", "3", 3), ("c", "1", 2)], ddl))
    assert {r["url"]: (r["digest"], r["prev_digest"], r["action"]) for r in got.collect()} == {"a": ("1", None, "kept"), "b": ("3", "1", "updated"), "c": ("1", None, "new")}


def test_citation_offsets_count_characters(spark):
    pages = spark.createDataFrame([(1, "h", "😀 abc def")], "doc_id long, page_hash string, page_text string")
    cited = spark.createDataFrame([(1, "h", 2, 5, "abc"), (1, "h", 3, 6, "abc"), (2, "h", 0, 1, "x")], "doc_id long, content_hash string, excerpt_start int, excerpt_end int, excerpt string")
    assert sorted(str(r["error"]) for r in lineage.verify_citations(cited, pages).collect()) == ["EEXCERPT", "ENOPAGE", "None"]


def test_statistics(spark):
    rng = random.Random(3)
    values = [(g, i, float(rng.random() < 0.6), 0.0) for g in ("x", "y") for i in range(60)] + [("one", 0, 1.0, 1.0)]
    rows = spark.createDataFrame(values, "g string, query_id int, value double, zero double")
    got = {r["g"]: r for r in evaluation.bootstrap_interval(rows, ["g"], resamples=400).collect()}
    for g in "xy":
        x = [v for k, _, v, _ in values if k == g]
        mean, error = sum(x) / 60, (sum((v - sum(x) / 60) ** 2 for v in x) / 60 / 60) ** 0.5
        assert got[g]["n"] == 60 and abs(got[g]["mean"] - mean) < 1e-9 and abs(got[g]["low"] - (mean - 1.96 * error)) < 0.05 and abs(got[g]["high"] - (mean + 1.96 * error)) < 0.05
    assert (got["one"]["low"], got["one"]["high"]) == (1.0, 1.0)
    p = {r["g"]: r["p"] for r in evaluation.permutation_test(rows, ["g"], "value", "zero").collect()}
    assert p["x"] < 0.01 and p["one"] == 1.0
    (whole,) = evaluation.permutation_test(rows, [], "zero", "zero", resamples=99).collect()
    assert whole["p"] == 1.0 and whole["n"] == 121 and evaluation.bootstrap_interval(rows.limit(0), ["g"]).count() == 0


def test_ordered_frontier(spark):
    rng = random.Random(4)
    links = {(f"s{k}", f"u{rng.randrange(60):02}", f"u{rng.randrange(60):02}") for k in (0, 1) for _ in range(150)}
    seeds = [("s0", "u05"), ("s0", "u01"), ("s1", "u09"), ("s1", None), ("s1", "u09")]
    got = {(r["section"], r["url"]): (r["round"], r["visit"]) for r in inventory.ordered_frontier(spark.createDataFrame(list(links), "section string, src string, dst string"), spark.createDataFrame(seeds, "section string, url string"), 15, 30).collect()}
    want = {}
    for s in ("s0", "s1"):
        level, n, r = sorted({u for k, u in seeds if k == s and u}), 0, 0
        queued = list(level)
        while level:
            r += 1
            for u in level:
                n += 1
                want[s, u] = (r - 1, n if n <= 15 else None)
            found = sorted({d for k, a, d in links if k == s and a in level and want[s, a][1]} - set(queued))
            level = found[: 30 - len(queued)]
            queued += level
    assert got == want and len(got) > 50 and sum(v[1] is not None for v in got.values()) == 30


def test_length_batches(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 3, 3, 50, 120]) for _ in range(400)] + [None, 0]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id int, s int").repartition(3)
    for padded in (False, True):
        out = batching.length_batches(rows, F.col("s"), 100, padded, most_rows=20).collect()
        groups = {}
        for r in out:
            groups.setdefault(r["batch"], []).append(r["batch_size"])
        assert len(out) == len(sizes) and all(len(g) == 1 or len(g) <= 20 and (len(g) * max(g) if padded else sum(g)) <= 100 for g in groups.values())
    assert batching.length_batches(rows.limit(0), F.col("s"), 10).count() == 0


def test_sitemaps_and_robots(spark):
    xml = "<?xml version='1.0'?><s:urlset xmlns:s='x'><s:url><s:loc>https://a.example/?a=1&amp;b=2</s:loc><s:lastmod>2024-01-01</s:lastmod></s:url></s:urlset>"
    assert [tuple(x) for x in one(spark, formats.sitemap_urls, xml)] == [("https://a.example/?a=1&b=2", "2024-01-01", False)]
    assert [x["loc"] for x in one(spark, formats.sitemap_urls, "<x><loc> u </loc></x>")] == ["u"]
    assert one(spark, formats.sitemap_bytes, bytearray(gzip.compress(b"<loc/>")), "binary") == "<loc/>"
    assert one(spark, inventory.robots_sitemaps, "User-agent: *\n Sitemap: https://a.example/s.xml") == ["https://a.example/s.xml"]


def test_specs(spark):
    spec = {"openapi": "3.0.0", "info": {"version": "1"}, "servers": [{"url": "https://h.example"}], "paths": {"/a": {"get": {"summary": "s", "parameters": [{"$ref": "#/components/parameters/p"}]}}}, "components": {"parameters": {"p": {"name": "q"}}}}
    rows = formats.import_specs(spark.createDataFrame([("f", json.dumps(spec)), ("g", "- no object")], "file string, content string")).collect()
    assert [(r["file"], r["method"], r["path"], r["base_url"]) for r in rows if r["error"] is None] == [("f", "GET", "/a", "https://h.example")]
    assert '"name": "q"' in rows[0]["request_schema"] and [r["file"] for r in rows if r["error"]] == ["g"]
    collection = {"item": [{"name": "folder", "item": [{"name": "n", "request": {"method": "post", "url": {"raw": "https://h.example/v1/o?x=1", "query": [{"key": "x"}, {"key": "x"}]}, "body": {"mode": "raw", "raw": '{"side": 1}'}}}]}]}
    (row,) = formats.requests_in(json.dumps(collection))
    assert (row["method"], row["path"], row["base_url"]) == ("POST", "/v1/o", "https://h.example") and json.loads(row["request_schema"])["parameters"] == [{"in": "query", "name": "x"}, {"in": "body", "name": "side"}]


def test_registry_and_jsonl(spark, tmp_path):
    got = formats.registry(spark, "sources:\n- id: a\n  allowed_domains: [a.example]\n  sections:\n  - id: s\n    inventory_policy: {priority: 5}\n- id: b\n").collect()
    assert [(r["source"], r["section"], r["mode"], r["priority"]) for r in got] == [("a", "s", "inventory", 5), ("b", None, "inventory", 100)]
    (tmp_path / "q.jsonl").write_text('# c\n\n{"query": "x"}\n')
    assert [r["query"] for r in formats.jsonl(spark, str(tmp_path / "q.jsonl"), "query string").collect()] == ["x"]


def test_store_folder(spark, tmp_path):
    folder = str(tmp_path / "store")
    folders.init(spark, folder)
    folders.init(spark, folder)
    assert folders.version(spark, folder) == folders.VERSION and folders.open_table(spark, folder, "pages").count() == 0
    assert folders.migrate(spark, folder, str(tmp_path / "new")) == []
    assert folders.schema("pages", 1) != folders.schema("pages", 2)


def test_streamed_upserts_survive_a_replay(spark, tmp_path):
    inbox, state = tmp_path / "in", f"file://{tmp_path}/store"
    for run, html in ((1, "<title>a</title> x"), (2, "<title>a</title> y"), (3, "<title>a</title> y")):
        rows = [(run, "https://a.example/p", html, None)] * 3 + [(run, f"https://a.example/{run}", html, None)]
        spark.createDataFrame(rows, crawl.PAGES).coalesce(1).write.mode("append").parquet(str(inbox))
        crawl.run_upserts(crawl.cleaned(crawl.page_batches(spark, str(inbox))), state, str(tmp_path / "cp")).awaitTermination(120)
    now = {r["url"]: (r["run"], r["action"], r["prev_digest"] == r["digest"]) for r in crawl.current_pages(spark, state).collect()}
    assert now == {"https://a.example/p": (3, "unchanged", True), "https://a.example/1": (1, "new", False), "https://a.example/2": (2, "new", False), "https://a.example/3": (3, "new", False)}
    then = {r["url"]: r["action"] for r in crawl.current_pages(spark, state, 2).collect()}
    assert then["https://a.example/p"] == "updated" and len(then) == 3
    before = commits.latest(spark, state)
    again = spark.createDataFrame([("https://a.example/p", "zzz", None, 9, "new")], crawl.CHANGES)
    crawl.change_sink(state)(again, 1)  # a batch that comes again
    assert commits.latest(spark, state) == before
    crawl.change_sink(state, compact_after=2)(again, 3)
    after = commits.latest(spark, state)
    assert len(after.parts("page_changes")) == 1 and after.version == before.version + 2
    assert {r["url"]: r["run"] for r in crawl.current_pages(spark, state).collect()}["https://a.example/p"] == 9


@pytest.mark.parametrize(("value", "want"), [(None, "question"), ("", "question"), ("?", "question")])
def test_classified_edge_cases(spark, value, want):
    assert one(spark, lambda c: routing.classified(c)[0], value) == want
