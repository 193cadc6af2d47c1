"""Queries over lexical and vector retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answer, evaluation, fusion, hybrid, lexical, segments, vector_index, vectors
from ..sources import places
from .registry import parts_of, query, sql_values, table, values

_TERMS = "(1, 'the'), (1, 'thonre'), (2, 'und'), (2, 'erber'), (3, 'que'), (3, 'ción'), (3, 'loser')"
_TOK = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_HITS = f"""q AS (SELECT query_id, term FROM {sql_values(_TERMS, 'query_id, term')}), d AS (SELECT doc_id, {_TOK} AS toks FROM documents), l AS (SELECT doc_id, len(toks) AS len FROM d), s AS (SELECT count(*) AS n, avg(len) AS avg FROM l),
t AS (SELECT doc_id, unnest(toks) AS term FROM d), h AS (SELECT query_id, doc_id, term, count(*) AS f FROM t JOIN q USING (term) GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM h GROUP BY ALL),
b AS (SELECT query_id, doc_id, count(*) AS n_terms, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM h JOIN df USING (query_id, term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1, 2)"""


def _scored(spark, sf_dir):
    queries = values(spark, _TERMS, "query_id, term")
    return lexical.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), queries, {"text": (F.col("text"), 1.0)}), queries


@query(f"WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """A top-k report for each query."""
    scored, _ = _scored(spark, sf_dir)
    return lexical.top(scored.withColumn("score", F.round("score", 9)), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_HITS} SELECT query_id, doc_id, n_terms FROM b WHERE n_terms = (SELECT count(*) FROM q WHERE q.query_id = b.query_id)")
def match_and(spark, sf_dir):
    scored, queries = _scored(spark, sf_dir)
    return lexical.matching(scored, queries, "AND").select("query_id", "doc_id", "n_terms")


@query(f"WITH {_HITS} SELECT query_id, doc_id, n_terms FROM b")
def match_or(spark, sf_dir):
    scored, queries = _scored(spark, sf_dir)
    return lexical.matching(scored, queries, "OR").select("query_id", "doc_id", "n_terms")


@query(f"WITH {_HITS}, a AS (SELECT * FROM b WHERE n_terms = (SELECT count(*) FROM q WHERE q.query_id = b.query_id)) SELECT query_id, doc_id FROM a UNION ALL SELECT query_id, doc_id FROM b WHERE query_id NOT IN (SELECT query_id FROM a)")
def match_with_fallback(spark, sf_dir):
    scored, queries = _scored(spark, sf_dir)
    return lexical.with_or_fallback(scored, queries).select("query_id", "doc_id")


_PHRASES = "(1, 'the', 0), (1, 'of', 1), (2, 'de', 0), (2, 'la', 1), (3, 'der', 0), (3, 'die', 1)"


@query(f"""
WITH d AS (SELECT doc_id, {_TOK} AS toks FROM documents), t AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS place FROM d), p AS (SELECT * FROM {sql_values(_PHRASES, 'query_id, term, pos')})
SELECT query_id, doc_id, count(*) AS n FROM (SELECT query_id, doc_id, place - pos AS start FROM t JOIN p USING (term) GROUP BY ALL HAVING count(*) = 2) GROUP BY 1, 2""")
def match_phrase(spark, sf_dir):
    return lexical.phrase(table(spark, sf_dir, "documents").select("doc_id", "text"), values(spark, _PHRASES, "query_id, term, pos"), F.col("text"))


_TITLE = "coalesce(nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ''), regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1))"


@query(f"""
WITH q AS (SELECT query_id, term FROM {sql_values(_TERMS, 'query_id, term')}), d AS (SELECT page_id AS doc_id, list_filter(string_split_regex(lower({_TITLE}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS a, list_filter(string_split_regex(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS b FROM pages),
l AS (SELECT doc_id, 10.0 * len(a) + len(b) AS len FROM d), s AS (SELECT count(*) AS n, avg(len) AS avg FROM l), t AS (SELECT doc_id, unnest(a) AS term, 10.0 AS w FROM d UNION ALL SELECT doc_id, unnest(b), 1.0 FROM d),
h AS (SELECT query_id, doc_id, term, sum(w) AS f FROM t JOIN q USING (term) GROUP BY ALL), df AS (SELECT query_id, term, count(*) AS df FROM h GROUP BY ALL)
SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM h JOIN df USING (query_id, term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1, 2""")
def bm25_fielded(spark, sf_dir):
    """Titles weigh ten times the body."""
    title = F.coalesce(F.nullif(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.lit("")), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), title.alias("title"), F.regexp_replace("html", "<[^>]+>", " ").alias("body"))
    scored = lexical.bm25(pages, values(spark, _TERMS, "query_id, term"), {"title": (F.col("title"), 10.0), "body": (F.col("body"), 1.0)})
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b),
x AS (SELECT query_id, doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS toks, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') AS gaps, (SELECT list(term) FROM q WHERE q.query_id = r.query_id) AS terms FROM r JOIN documents USING (doc_id) WHERE rank <= 3),
w AS (SELECT *, [list_contains(terms, lower(t)) FOR t IN toks] AS hit FROM x), m AS (SELECT *, list_transform(range(0, greatest(len(toks) - 12, 0) + 1), lambda i: len(list_filter(hit[i + 1 : i + 12], lambda y: y))) AS sums FROM w),
a AS (SELECT *, list_position(sums, list_max(sums)) - 1 AS s FROM m)
SELECT query_id, doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(range(s + 1, least(s + 12, len(toks)) + 1), lambda i: CASE WHEN i > s + 1 THEN gaps[i] ELSE '' END || CASE WHEN hit[i] THEN '[' || toks[i] || ']' ELSE toks[i] END), '')
       || CASE WHEN s + 12 < len(toks) THEN '...' ELSE '' END AS snippet FROM a""")
def snippets(spark, sf_dir):
    """A top-k report with the first window of twelve words that holds most of a query's terms."""
    scored, queries = _scored(spark, sf_dir)
    terms = queries.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    best = lexical.top(scored.withColumn("score", F.round("score", 9)), 3).join(terms, "query_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return segments.snippets(best, "text", "terms").select("query_id", "doc_id", "snippet")


_PAGE_URL = "url || CASE page_id % 3 WHEN 0 THEN '/errors/codes' WHEN 1 THEN '/guide' ELSE '' END"


@query(f"SELECT id, url, position FROM (SELECT page_id AS id, {_PAGE_URL} AS url, row_number() OVER (ORDER BY CASE WHEN contains(lower({_PAGE_URL}), 'error') THEN 0 ELSE 1 END, strlen(html), page_id) AS position FROM pages) WHERE position <= 20")
def error_code_search(spark, sf_dir):
    """A top-k report: error pages first, then by rank, here the page's length."""
    p = table(spark, sf_dir, "pages")
    tail = F.when(F.col("page_id") % 3 == 0, "/errors/codes").when(F.col("page_id") % 3 == 1, "/guide").otherwise("")
    return answer.error_pages_first(p.select(F.col("page_id").alias("id"), F.concat("url", tail).alias("url"), F.octet_length("html").alias("rank")), 20)


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NORM = "sqrt(list_dot_product({x}.embedding::DOUBLE[], {x}.embedding::DOUBLE[]))"


@query("""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(distance, 5) AS distance, rank FROM r WHERE rank <= 10""")
def knn_l2(spark, sf_dir):
    """Queries: every vector whose id 50 divides, against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.knn(e, e.filter("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@query(f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, 1 - {_DOT} / ({_NORM.format(x='a')} * {_NORM.format(x='b')}) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(distance, 5) AS distance, rank FROM r WHERE rank <= 10""")
def knn_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.knn(e, e.filter("vec_id % 50 = 0"), 10, "cosine").select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


# Two ranked lists for each part: its suppliers by price and by quantity. No part has all suppliers in both.
_LEX = "(SELECT l_partkey AS query_id, 's' || l_suppkey AS key, max(l_extendedprice) / 100000 AS score FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)"
_SEM = "(SELECT l_partkey AS query_id, 's' || l_suppkey AS key, max(l_quantity) / 50 AS score FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL)"


_LINES = 500_000  # of a partition


def _side(spark, sf_dir, lex):
    """One of the lists. A part's lines are dealt to one partition, so that no later step by part moves them again."""
    whole = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    l = whole.filter(F.col("l_returnflag") != ("R" if lex else "A")).repartition(parts_of(whole, _LINES), "l_partkey")  # noqa: E741
    score = F.max("l_extendedprice") / 100_000 if lex else F.max("l_quantity") / 50
    return l.groupBy(F.col("l_partkey").alias("query_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("key")).agg(score.alias("score"))


def _ranks(df, list_id, weight):
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return df.withColumns({"rank": F.row_number().over(w), "list_id": F.lit(list_id), "weight": F.lit(weight)})


@query(f"""
WITH u AS (SELECT query_id, key, 0.7 AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM {_LEX} UNION ALL SELECT query_id, key, 1.3, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) FROM {_SEM})
SELECT query_id, key, round(sum(w / (60 + r))::DOUBLE, 9) AS score FROM u GROUP BY 1, 2""")
def rrf_fuse(spark, sf_dir):
    lists = _ranks(_side(spark, sf_dir, True), 1, 0.7).unionByName(_ranks(_side(spark, sf_dir, False), 2, 1.3))
    return fusion.rrf(lists).select("query_id", "key", F.round("score", 9).alias("score"))


_KINDS = ("question", "endpoint_path", "code_snippet", "error_message", "request_payload")


@query(f"""
WITH k AS (SELECT p_partkey AS query_id, {list(_KINDS)}[1 + p_size % 5] AS kind FROM part), w AS (SELECT query_id, CASE WHEN kind IN ('error_message', 'request_payload') THEN 1.3 ELSE 0.7 END AS a FROM k),
u AS (SELECT query_id, key, false AS sem, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM {_LEX} UNION ALL SELECT query_id, key, true, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) FROM {_SEM})
SELECT query_id, key, round(sum(CASE WHEN sem THEN 2.0 - a ELSE a END / (60 + r))::DOUBLE, 9) AS score FROM u JOIN w USING (query_id) GROUP BY 1, 2""")
def rrf_by_kind(spark, sf_dir):
    """The weights of the two lists by the kind of input."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.element_at(F.array(*map(F.lit, _KINDS)), F.col("p_size") % 5 + 1).alias("kind"))
    lists = _ranks(_side(spark, sf_dir, True), 1, 1.0).unionByName(_ranks(_side(spark, sf_dir, False), 2, 1.0)).join(kinds, "query_id")
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.when(F.col("list_id") == 1, a).otherwise(b)) for k, (a, b) in fusion.RRF_WEIGHTS.items()))
    return fusion.rrf(lists.withColumn("weight", weight)).select("query_id", "key", F.round("score", 9).alias("score"))


def _mm(rows, name):
    return f"(SELECT query_id, key, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END::DOUBLE AS {name} FROM {rows} WINDOW w AS (PARTITION BY query_id))"


@query(f"SELECT query_id, key, round(0.4 * coalesce(l, 0) + 0.6 * coalesce(s, 0), 9) AS score, (l IS NOT NULL AND s IS NOT NULL) AS in_both FROM {_mm(_LEX, 'l')} a FULL JOIN {_mm(_SEM, 's')} b USING (query_id, key)")
def cc_fuse(spark, sf_dir):
    return fusion.convex(_side(spark, sf_dir, True), _side(spark, sf_dir, False), 0.4).withColumn("score", F.round("score", 9))


@query(f"WITH a AS ({_mm(_LEX, 'l')[1:-1]}), b AS ({_mm(_SEM, 's')[1:-1]}), g AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS alpha), c AS (SELECT alpha, query_id, key, alpha::DOUBLE * coalesce(l, 0) + (1 - alpha::DOUBLE) * coalesce(s, 0) AS score FROM a FULL JOIN b USING (query_id, key) CROSS JOIN g) SELECT alpha::DOUBLE AS alpha, query_id, arg_max(key, (round(score, 6), key)) AS best FROM c GROUP BY 1, 2")
def alpha_sweep(spark, sf_dir):
    """The best key of each part at five mixtures."""
    side = lambda lex, n: _side(spark, sf_dir, lex).withColumn(n, fusion.minmax("score")).select("query_id", "key", n)
    return evaluation.alpha_sweep(side(True, "l"), side(False, "s"), (0.0, 0.25, 0.5, 0.75, 1.0), parts_of(table(spark, sf_dir, "lineitem"), _LINES))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM {_LEX}) SELECT query_id, max(score) FILTER (r = 1) >= 0.5 AND (count(*) = 1 OR max(score) FILTER (r = 1) - max(score) FILTER (r = 2) >= 0.05) AS strong FROM r GROUP BY 1")
def strong_signal(spark, sf_dir):
    return fusion.strong_signal(_side(spark, sf_dir, True), 0.5, 0.05)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM {_LEX}), s AS (SELECT query_id, count(*) AS n, max(score) FILTER (r = 1) AS a, max(score) FILTER (r = 2) AS b, min(score) FILTER (r <= 5) AS z FROM r GROUP BY 1),
d AS (SELECT query_id, CASE WHEN n < 6 THEN 'few_candidates' WHEN round(a - b, 12) <= 0.006 OR round(a - z, 12) <= 0.02 THEN 'ambiguous' ELSE 'confident' END AS reason FROM s) SELECT query_id, reason = 'ambiguous' AS rerank, reason FROM d""")
def auto_rerank(spark, sf_dir):
    return fusion.auto_rerank(_side(spark, sf_dir, True), 5)


@query(f"""
WITH r AS (SELECT l.query_id, l.key, l.score, row_number() OVER (PARTITION BY l.query_id ORDER BY l.score DESC, l.key) AS rank, s.score * 4 - 2 AS rerank FROM {_LEX} l LEFT JOIN {_SEM} s ON s.query_id = l.query_id AND s.key = l.key)
SELECT query_id, key, round(CASE WHEN rerank IS NULL THEN n ELSE w * n + (1 - w) / (1 + exp(-rerank)) END::DOUBLE, 9) AS score FROM (SELECT *, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS n, CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END AS w FROM r)""")
def position_blend(spark, sf_dir):
    """The first list blended with what the second gives as a model's score, where it has one."""
    model = _side(spark, sf_dir, False).select("query_id", "key", (F.col("score") * 4 - 2).alias("rerank"))
    rows = _ranks(_side(spark, sf_dir, True), 1, 1.0).select("query_id", "key", "rank", "score").join(model, ["query_id", "key"], "left")
    return fusion.position_blend(rows).withColumn("score", F.round("score", 9))


_FOLDERS = ("introduction", "x", "rest-api", "rate-limits", "orders")


@query(f"SELECT page_id AS id, conv_id, turn, round(CASE WHEN regexp_matches(u, '{fusion.OVERVIEW}') AND regexp_matches(q, '{fusion.BROAD}') THEN score * 1.4 ELSE score END::DOUBLE, 6) AS score FROM (SELECT page_id, url || '/' || {list(_FOLDERS)}[1 + page_id % 5] AS u, c.text AS q, conv_id, turn, strlen(html) / 1000.0 AS score FROM pages JOIN conversations c ON conv_id = page_id)")
def page_type_boost(spark, sf_dir):
    """Pages scored for the turns of the conversation with their number."""
    asked = table(spark, sf_dir, "conversations").select(F.col("conv_id"), "turn", F.col("text").alias("q"))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/"), F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("page_id") % 5 + 1).cast("int"))).alias("u"), (F.octet_length("html") / 1000.0).alias("score"))
    rows = p.join(asked, F.col("conv_id") == F.col("page_id"))
    return rows.select(F.col("page_id").alias("id"), "conv_id", "turn", F.round(fusion.page_type_boost(F.col("score"), F.col("u"), F.col("q")), 6).alias("score"))


@query("""
WITH r AS (SELECT l_returnflag AS query_id, l_orderkey AS page, l_partkey AS chunk, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 1000)
SELECT query_id, page, min(rank) AS rank, arg_min(chunk, rank) AS chunk FROM r GROUP BY 1, 2""")
def best_chunk_per_doc(spark, sf_dir):
    """The first row of each page in ranked lists of a thousand rows."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("query_id"), F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.col("l_partkey").alias("chunk"), F.col("l_extendedprice").alias("score"))  # noqa: E741
    ranked = lexical.top(l, 1_000, F.struct((-F.col("score")).alias("p"), "doc_id", "l_linenumber"))
    return fusion.best_per(ranked.select("query_id", F.col("doc_id").alias("page"), "rank", "chunk"), "page")


@query(f"""
WITH {_HITS}, lx AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM b QUALIFY r <= 20),
v AS (SELECT a.vec_id / 50 + 1 AS query_id, b.vec_id AS doc_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id IN (0, 50, 100) AND a.vec_id <> b.vec_id),
vs AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS r FROM v QUALIFY r <= 20), u AS (SELECT query_id, doc_id, 0.7 AS w, r FROM lx UNION ALL SELECT query_id, doc_id, 1.3, r FROM vs),
f AS (SELECT query_id, doc_id, round(sum(w / (60 + r))::DOUBLE, 9) AS score FROM u GROUP BY 1, 2) SELECT query_id::BIGINT AS query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_search(spark, sf_dir):
    """Lexical and vector lists of three queries, fused by reciprocal rank; a top-k report."""
    scored, _ = _scored(spark, sf_dir)
    lex = lexical.top(scored.withColumn("score", F.round("score", 9)), 20).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("doc_id").alias("key"), "rank", F.lit(0.7).alias("weight"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    sem = vectors.knn(e, e.filter("vec_id IN (0, 50, 100)"), 20).select((F.col("query_id") / 50 + 1).cast("bigint").alias("query_id"), F.col("vec_id").alias("key"), "rank", F.lit(1.3).alias("weight"))
    fused = fusion.rrf(lex.unionByName(sem)).select("query_id", F.col("key").alias("doc_id"), F.round("score", 9).alias("score"))
    return lexical.top(fused, 10)


_CITED = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/openapi.yaml' END"


@query(f"SELECT page_id, CASE WHEN c IS NOT NULL AND NOT regexp_matches(lower(c), 'openapi|swagger|\\.ya?ml$') THEN c WHEN found IS NOT NULL THEN found WHEN s IS NOT NULL AND NOT regexp_matches(lower(s), 'openapi|swagger|\\.ya?ml$') THEN s END AS url FROM (SELECT page_id, {_CITED} AS c, CASE WHEN page_id % 3 = 0 THEN 'https://found.example/' || page_id END AS found, CASE WHEN page_id % 5 < 3 THEN url WHEN page_id % 5 = 3 THEN url || '/swagger.json' END AS s FROM pages)")
def citation_url(spark, sf_dir):
    """What an answer cites: the documented URL, unless it is a specification, else the one that was found, else the source."""
    i, url = F.col("page_id"), F.col("url")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.when(i % 4 == 0, url).when(i % 4 == 1, F.concat(url, F.lit("/openapi.yaml"))).alias("docs_url"), F.when(i % 3 == 0, F.concat(F.lit("https://found.example/"), i.cast("string"))).alias("found"),
        F.when(i % 5 < 3, url).when(i % 5 == 3, F.concat(url, F.lit("/swagger.json"))).alias("source"),
    )
    return rows.select("page_id", answer.citation_url(F.col("docs_url"), F.col("found"), F.col("source")).alias("url"))


@query("SELECT count(*) AS n_queries, 10 AS k, count(*) * 10 AS found, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf_dir):
    """An approximate index is built, every fiftieth vector asked for its ten nearest, and the result held against the exact search: at least nine of ten are found. The numbers of lists and candidates a query are set by other queries."""
    e, root = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), places.fresh(spark, "vectors")
    vector_index.add(e.filter("vec_id % 3 > 0"), root)
    vector_index.add(e.filter("vec_id % 3 = 0"), root)
    probes, candidates = vector_index.settings_for(spark, root, e, e.filter("vec_id % 50 = 25"), 10)
    found = vector_index.search(spark, root, e.filter("vec_id % 50 = 0"), 10, probes, candidates)
    measured = vector_index.recall(found, e, e.filter("vec_id % 50 = 0"), 10)
    return measured.crossJoin(found.agg(F.count("*").alias("found"))).select("n_queries", F.lit(10).alias("k"), "found", (F.col("recall") >= 0.9).alias("enough"))


# Questions 1 and 2 are bound to a source; pages are pairs of documents; vectors of documents are those with their number.
_ASKED = "(1, 'question', 'src1'), (2, 'error_message', 'src2'), (3, 'code_snippet', NULL)"


def _hybrid_sql(k: int, over: int) -> str:
    lists = lambda name, rows: f"""  # noqa: E731
{name}0 AS (SELECT f.query_id, f.key, f.score, f.key // 2 AS page FROM ({rows}) f JOIN asked a ON a.query_id = f.query_id WHERE a.source IS NULL OR a.source = 'src' || (f.key % 3)),
{name}1 AS (SELECT * FROM {name}0 QUALIFY row_number() OVER (PARTITION BY query_id, page ORDER BY score DESC, key) = 1),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM {name}1 QUALIFY rank <= {over * k})""".replace("  # noqa: E731", "")
    return f"""
WITH {_HITS}, asked AS (SELECT query_id, kind, source FROM {sql_values(_ASKED, 'query_id, kind, source')}),
{lists('lx', "SELECT query_id, doc_id AS key, round(score, 9) AS score FROM b")},
{lists('se', "SELECT a.vec_id / 50 + 1 AS query_id, e.vec_id AS key, -round(list_distance(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE a.vec_id IN (0, 50, 100) QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) <= 300")},
nm AS (SELECT query_id, rank, abs(score) / (1 + abs(score)) AS score FROM lx), sg AS (SELECT query_id FROM nm GROUP BY 1 HAVING max(score) FILTER (rank = 1) >= 0.85 AND (count(*) = 1 OR max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) >= 0.01)),
sv AS (SELECT se.query_id, coalesce(lx.key, se.key) AS key, se.rank FROM se LEFT JOIN lx ON lx.query_id = se.query_id AND lx.page = se.page WHERE se.query_id NOT IN (SELECT query_id FROM sg)),
u AS (SELECT query_id, key, rank, true AS lexical FROM lx UNION ALL SELECT query_id, key, rank, false FROM sv),
f AS (SELECT u.query_id, key, round(sum(CASE WHEN lexical = (kind IN ('error_message', 'request_payload')) THEN 1.3 ELSE 0.7 END / (60 + rank))::DOUBLE, 9) AS score FROM u JOIN asked a ON a.query_id = u.query_id GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM f),
d2 AS (SELECT query_id, count(*) >= 6 AND (round(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 12) <= 0.006 OR round(max(score) FILTER (r = 1) - min(score) FILTER (r <= 5), 12) <= 0.02) AS wants FROM fr GROUP BY 1),
bl AS (SELECT fr.query_id, key, wants, CASE WHEN NOT wants THEN score WHEN key % 4 = 0 THEN n ELSE w * n + (1 - w) / (1 + exp(-(key % 7 - 3))) END AS score FROM (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS n, CASE WHEN r <= 3 THEN 0.75 WHEN r <= 10 THEN 0.6 ELSE 0.4 END AS w FROM fr) fr JOIN d2 USING (query_id))
SELECT query_id::BIGINT AS query_id, key AS doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank, query_id NOT IN (SELECT query_id FROM sg) AS used_vectors, wants AS reranked FROM bl QUALIFY rank <= {k}"""


@query(_hybrid_sql(10, hybrid.OVER_FETCH))
def hybrid_search_filtered(spark, sf_dir):
    """Hybrid search with a source for two of three questions, pages of two documents each, a strong lexical signal that leaves the vectors out, and a model's scores for three quarters of the documents; a top-k report."""
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scored, _ = _scored(spark, sf_dir)
    lex = scored.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("doc_id").alias("key"), F.round("score", 9).alias("score"))
    near = vectors.knn(e, e.filter("vec_id IN (0, 50, 100)"), 300, with_self=True)
    sem = near.select((F.col("query_id") / 50 + 1).cast("bigint").alias("query_id"), F.col("vec_id").alias("key"), (-F.round("distance", 6)).alias("score"))
    asked = values(spark, _ASKED, "query_id, kind, source").withColumn("query_id", F.col("query_id").cast("bigint"))
    pages = docs.select(F.col("doc_id").alias("key"), F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("source"), F.expr("doc_id DIV 2").alias("page"))
    model = docs.filter("doc_id % 4 > 0").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 7 - 3).cast("double").alias("rerank")).crossJoin(F.broadcast(asked.select("query_id")))  # three questions
    found = hybrid.search(asked, lex, sem, pages, 10, rerank=model, strong=(0.85, 0.01))
    return found.withColumnRenamed("key", "doc_id")
