"""Answers as claims with citations, for a batch of questions.

A question's source is the one that it names, else the one that its code or payload tells, else the one that has a record
of its path. Without one it needs a clarification; so does one that names several and does not compare them. Questions
that are clearly an endpoint's path or an error's code go straight to records and pages that have it; where no record has
one of the path's last two segments, or no page the code, the answer is undocumented. All others are searched: records of
the source (3), then pages by BM25, and by vectors where a ranked list is given, fused by weights of the input's kind, 3 a
section and 5 of the section that the question names; section and page-type boosts; pages of that section first; 10 claims.
Each claim of a page has an excerpt that is a slice of the text, so a citation can be checked.

Everything is joined by question, a batch at a time: questions are a stated set, pages and records are read by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents, pages, text, urls
from ..sources import places
from . import extraction, fusion, lexical, matching, records, routing

MAX_CLAIMS, MAX_COMPARED = 10, 4
RECORDS, PER_SECTION, OF_SECTION = 3, 3, 5
DIRECT = 0.7
SURE = 0.5

#: Alpha of the convex fusion by kind of input.
CC_ALPHA = {"question": 0.35, "endpoint_path": 0.35, "error_message": 0.65, "code_snippet": 0.35, "request_payload": 0.65}
COMPARES = r"(?i)\b(compare|comparison|versus|vs\.?|difference|differ|between|both)\b"


def _held(df: DataFrame) -> DataFrame:
    """A step's rows, a few for each stated question, written to the shared folder, so that later steps don't plan and run it again."""
    path = places.fresh(df.sparkSession, "answers")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_signal(c: Column) -> tuple[Column, Column]:
    """(path, method) that a question names; null without."""
    method, path = F.upper(F.trim(F.regexp_extract(c, routing._PATH, 1))), F.regexp_extract(c, routing._PATH, 2)
    return F.nullif(F.regexp_replace(path, r"[?.,;:)]+$", ""), F.lit("")), F.nullif(method, F.lit(""))


def error_codes(c: Column) -> Column:
    """The error codes of a text, in the order of the patterns, each once."""
    found = F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for _, p in routing.ERROR_CODES)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_extract(x, r"(-?\d+)", 1)), lambda x: x != ""))


def asked(questions: DataFrame, registry: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """questions with norm, kind, confidence, path, method, codes, sources (those it is about). registry: source, name, ord, sections; known: records (source, path) for a reverse lookup."""
    q = F.col("question")
    kind, confidence = routing.classified(q)
    path, method = path_signal(q)
    rows = questions.select("query_id", "question", text.normalized_question("question").alias("norm"), kind.alias("kind"), confidence.alias("confidence"), path.alias("path"), method.alias("method"), error_codes(q).alias("codes"))
    named = routing.detected_sources(rows, registry.select("ord", "source", "name"), "query_id", "norm")
    hint = F.coalesce(intents.code_context(q)["source_hint"], matching.payload_source(q))
    out = rows.join(named, "query_id", "left").withColumn("hint", hint)
    ids = registry.select(F.col("source").alias("hint"), F.lit(True).alias("__known")).distinct()
    out = out.join(ids, "hint", "left").withColumn("sources", F.coalesce("sources", F.when(F.col("__known"), F.array("hint")))).drop("hint", "__known")
    if known is not None:
        by_path = known.groupBy(urls.path_for_dedup("path").alias("__p")).agg(F.array_sort(F.collect_set("source")).alias("__s"))  # a path's sources, some tens at most
        out = out.withColumn("__p", F.when(F.col("sources").isNull(), urls.path_for_dedup("path"))).join(by_path, "__p", "left").withColumn("sources", F.coalesce("sources", "__s")).drop("__p", "__s")
    return out.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def terms_of(questions: DataFrame) -> DataFrame:
    """(query_id, term): search terms without the source's name, of program text also without words of code, or, where these are all, its two longest; of a payload the action that its keys stand for, else its keys."""
    names = F.col("sources")
    strip = lambda terms: F.filter(terms, lambda t: ~F.array_contains(names, t))
    plain = strip(text.search_terms("norm"))
    bare = strip(text.search_terms("norm", text.CODE_STOPWORDS))
    longest = F.slice(F.array_sort(plain, lambda a, b: F.length(b) - F.length(a)), 1, 2)
    skipped = F.array(*(F.lit(k) for k in ("timestamp", "recvwindow", "signature", "apikey", "symbol", "type", "side")))
    keys = F.transform(F.coalesce(F.json_object_keys("question"), F.array().cast("array<string>")), F.lower)
    telling = F.slice(F.filter(keys, lambda k: ~F.array_contains(skipped, k)), 1, 4)
    action = matching.payload_action(F.col("question"))
    payload = F.when(action.isNotNull(), text.search_terms(action)).when(F.size(telling) > 0, telling).otherwise(F.slice(keys, 1, 3))
    terms = F.when(F.col("kind") == "code_snippet", F.when(F.size(bare) > 0, bare).otherwise(longest)).when((F.col("kind") == "request_payload") & (F.size(keys) > 0), payload).otherwise(plain)
    return questions.select("query_id", F.explode(F.array_distinct(F.slice(F.flatten(F.transform(terms, lambda t: F.split(t, r"[^\p{L}\p{N}]+"))), 1, text.MAX_TERMS))).alias("term")).filter("term <> ''")


def page_list(questions: DataFrame, terms: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the pages of a question's sources by BM25, all terms first; pages of test systems only for questions that name the testnet, left out before the cut. docs: doc_id, source, section, url, text."""
    scored = lexical.bm25(docs, terms, {"text": (F.col("text"), 1.0)}, only=F.col("source").isin(_sources(questions)))
    placed = scored.join(docs.select("doc_id", "source", "section", "url"), "doc_id").join(F.broadcast(questions.select("query_id", "norm", "sources")), "query_id")  # the stated questions
    own = placed.filter(F.array_contains("sources", F.col("source")) & intents.shown_for("url", "norm") & ~matching.is_spec(F.col("url")))
    best = lexical.top_with_fallback(own.select("query_id", "doc_id", "section", "url", "score", "n_terms"), terms, k)
    return best.select("query_id", F.col("doc_id").alias("key"), "section", "url", intents.bm25_normalized("score").alias("score"), "rank")


def fused(lexical_list: DataFrame, semantic: DataFrame | None, questions: DataFrame, mode: str = "rrf") -> DataFrame:
    """(query_id, key, score): both lists by reciprocal ranks (rrf) or a convex sum of scores (cc), weighted by the question's kind; one list alone where the other is missing. Lists: query_id, key, score, rank."""
    if mode not in ("rrf", "cc"):
        raise ValueError(f"EBADMODE: {mode!r}")
    kinds = questions.select("query_id", "kind")
    if semantic is None:
        semantic = lexical_list.limit(0)
    if mode == "cc":
        alpha = F.create_map(*(x for k, a in CC_ALPHA.items() for x in (F.lit(k), F.lit(a))))
        a = lexical_list.join(kinds, "query_id")
        sides = a.select("query_id", "key", fusion.minmax("score").alias("l"), F.lit(0.0).alias("s")).unionByName(semantic.select("query_id", "key", F.lit(0.0).alias("l"), fusion.minmax("score").alias("s")))
        sums = sides.groupBy("query_id", "key").agg(F.sum("l").alias("l"), F.sum("s").alias("s")).join(kinds, "query_id")
        w = F.coalesce(alpha[F.col("kind")], F.lit(0.5))
        return sums.select("query_id", "key", (w * F.col("l") + (1 - w) * F.col("s")).alias("score"))
    weight = lambda side: F.coalesce(F.create_map(*(x for k, w in fusion.RRF_WEIGHTS.items() for x in (F.lit(k), F.lit(w[side]))))[F.col("kind")], F.lit(1.0))
    lists = [df.join(kinds, "query_id").select("query_id", F.lit(i).alias("list_id"), "key", "rank", weight(i).alias("weight")) for i, df in enumerate((lexical_list, semantic))]
    return fusion.rrf(lists[0].unionByName(lists[1]))


def direct_paths(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, order, record_id): the records of the question's sources that have its path, and its method where it names one; the first five."""
    q = questions.filter((F.col("kind") == "endpoint_path") & (F.col("confidence") >= DIRECT) & F.col("path").isNotNull())
    q = q.select("query_id", "sources", "method", urls.path_for_dedup("path").alias("__p"))
    hit = q.join(known.select("record_id", "source", F.upper("method").alias("__m"), urls.path_for_dedup("path").alias("__p")), "__p")
    hit = hit.filter(F.array_contains("sources", F.col("source")) & (F.col("method").isNull() | (F.col("method") == F.col("__m"))))
    return hit.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "__m", "record_id")).alias("order"), "record_id").filter("order <= 5")


def _sources(questions: DataFrame) -> list[str]:
    """The sources that the stated questions are about."""
    return sorted(r["source"] for r in questions.select(F.explode("sources").alias("source")).distinct().collect())


def _with_code(codes: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, doc_id, source, url): the pages of the questions' sources that have a code as a word. codes: term, sources, of the stated questions; a code is digits, so only texts that hold it are taken apart."""
    words = sorted(r["term"] for r in codes.select("term").distinct().collect())
    there = F.lit(False)
    for w in words:
        there = there | F.contains("text", F.lit(w))
    own = docs.filter(F.col("source").isin(_sources(codes)) & there)
    found = F.explode(F.array_intersect(text.tokens(F.col("text")), F.array(*(F.lit(w) for w in words)).cast("array<string>")))
    return own.select(found.alias("term"), "doc_id", "source", "url")


def direct_errors(questions: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, order, doc_id, code): the pages of the question's sources that have one of its first three codes as a word; those with "error" in their URL first."""
    q = questions.filter((F.col("kind") == "error_message") & (F.col("confidence") >= DIRECT)).select("query_id", "sources", F.explode(F.slice("codes", 1, 3)).alias("code"))
    q = q.withColumn("term", F.regexp_replace("code", "^-", ""))
    hit = _with_code(q, docs).join(F.broadcast(q), "term").filter(F.array_contains("sources", F.col("source")))  # the stated questions
    first = F.when(F.lower("url").contains("error"), 0).otherwise(1)
    best = hit.groupBy("query_id", "doc_id").agg(F.min(F.struct(first.alias("f"), "url")).alias("f"), F.min("code").alias("code"))
    return best.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("f", "doc_id")).alias("order"), "doc_id", "code").filter(F.col("order") <= k)


def undocumented(questions: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id): clear paths whose last two telling segments no record path of the source holds, though the source has records; clear codes that no page of the source holds."""
    q = questions.filter((F.col("kind") == "endpoint_path") & (F.col("confidence") >= DIRECT) & F.col("path").isNotNull())
    q = q.select("query_id", "sources", F.slice(F.reverse(matching.segments(F.col("path"))), 1, 2).alias("segments")).filter(F.size("segments") > 0)
    parts = known.select("source", F.explode(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), F.lower)).alias("part"))
    by_source = parts.join(F.broadcast(q.select("query_id", "segments", F.explode("sources").alias("source"))), "source")  # the stated questions
    has = F.exists("segments", lambda s: F.contains("part", F.lower(s)))
    paths = by_source.groupBy("query_id").agg(F.max(has).alias("has")).filter("NOT has").select("query_id")
    codes = questions.filter((F.col("kind") == "error_message") & (F.col("confidence") >= DIRECT) & (F.size("codes") > 0)).select("query_id", "sources", F.explode("codes").alias("code")).withColumn("term", F.regexp_replace("code", "^-", ""))
    found = _with_code(codes, docs).select("term", "source").distinct().join(F.broadcast(codes), "term").filter(F.array_contains("sources", F.col("source")))  # the stated questions
    return paths.unionByName(codes.select("query_id").distinct().join(found.select("query_id"), "query_id", "left_anti"))


def searched(questions: DataFrame, terms: DataFrame, docs: DataFrame, registry: DataFrame, semantic: DataFrame | None, mode: str, rerank: DataFrame | None = None, policy: str | bool | None = None) -> DataFrame:
    """(query_id, order, doc_id, score): pages by the fused score (the lexical list alone where its first score is clearly ahead), with a model's scores blended in where the policy wants them, boosted, those of the question's section first; PER_SECTION of a section, OF_SECTION of that one, MAX_CLAIMS in all."""
    sections = registry.groupBy("source").agg(F.first("sections").alias("sections"))
    q = questions.select("query_id", "norm", "kind", F.try_element_at("sources", F.lit(1)).alias("source")).join(sections, "source", "left")
    q = q.withColumn("section", intents.section("norm", F.col("source"), F.coalesce("sections", F.array().cast("array<string>"))))
    lists = page_list(questions, terms, docs, 10 * MAX_CLAIMS)
    if semantic is not None:
        sure = fusion.strong_signal(lists.select("query_id", "key", "score")).filter("strong").select("query_id")
        semantic = semantic.join(sure, "query_id", "left_anti")
    both = fusion.reranked(fused(lists, semantic, questions, mode), rerank, MAX_CLAIMS, policy).drop("reranked")
    rows = both.join(docs.select(F.col("doc_id").alias("key"), F.col("section").alias("of"), "url"), "key").join(F.broadcast(q.select("query_id", "norm", "section")), "query_id")  # the stated questions
    in_section = F.coalesce(F.col("of") == F.col("section"), F.lit(False))
    score = fusion.page_type_boost(F.when(in_section, F.col("score") * 1.3).otherwise(F.col("score")), F.col("url"), F.col("norm"))
    rows = rows.withColumns({"score": F.round(score, 9), "first": in_section})
    w = Window.partitionBy("query_id", "of").orderBy(F.col("score").desc(), "key")
    rows = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.when(F.col("first"), OF_SECTION).otherwise(PER_SECTION))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("first").desc(), F.col("score").desc(), "key"))
    return rows.select("query_id", order.alias("order"), F.col("key").alias("doc_id"), "score").filter(F.col("order") <= MAX_CLAIMS)


def _page_claims(rows: DataFrame, docs: DataFrame, needles: DataFrame) -> DataFrame:
    """rows (query_id, order, doc_id, score) as claims with excerpts about the question's needles."""
    with_text = rows.join(docs.select("doc_id", "url", "text"), "doc_id").join(needles, "query_id", "left")
    cited = with_text.withColumn("x", pages.excerpt_about("text", F.coalesce("needles", F.array().cast("array<string>"))))
    return cited.select("query_id", F.lit(1).alias("group"), "order", F.lit("SOURCE").alias("kind"), F.lit(None).cast("string").alias("record_id"), F.col("doc_id").cast("string").alias("doc_id"), "url", "score", F.col("x.excerpt").alias("excerpt"), F.col("x.excerpt_start").alias("excerpt_start"), F.col("x.excerpt_end").alias("excerpt_end"), F.sha2("text", 256).alias("content_hash"))


def _record_claims(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (query_id, order, record_id, score) as claims; their URL is the record's documentation, unless it is a spec."""
    said = F.concat(F.lit("["), "source", F.lit(":"), F.coalesce("section", F.lit("")), F.lit("] "), F.coalesce("method", F.lit("")), F.lit(" "), "path", F.lit(" — "), F.coalesce("text", F.lit("")))
    none = lambda t: F.lit(None).cast(t)
    url = F.when(~matching.is_spec(F.coalesce("docs_url", F.lit(""))), F.col("docs_url"))
    return rows.join(known, "record_id").select("query_id", F.lit(0).alias("group"), "order", F.lit("ENDPOINT").alias("kind"), "record_id", none("string").alias("doc_id"), url.alias("url"), "score", said.alias("excerpt"), none("int").alias("excerpt_start"), none("int").alias("excerpt_end"), none("string").alias("content_hash"))


def answers(questions: DataFrame, docs: DataFrame, registry: DataFrame, known: DataFrame, semantic: DataFrame | None = None, mode: str = "rrf", rerank: DataFrame | None = None, policy: str | bool | None = None) -> DataFrame:
    """(query_id, status, route, input_type, sources, claims): status ok, not_found, undocumented or needs_clarification; route direct or search, null without claims. claims: structs of id, kind (ENDPOINT, SOURCE), record_id, doc_id, url, score, excerpt, excerpt_start, excerpt_end, content_hash.

    questions: query_id, question; docs: doc_id, source, section, url, text; registry: source, name, ord, sections; known: record_id, source, section, method, path, text, docs_url; semantic: query_id, key (doc_id), score, rank; rerank: query_id, key, rerank, a model's scores, used by the policy (auto, always, never).
    """
    q = _held(asked(questions, registry, known))
    n = F.size("sources")
    unclear = (n == 0) | ((n > 1) & ~(F.col("norm").rlike(COMPARES) & (n <= MAX_COMPARED)) & ~((F.col("kind") == "endpoint_path") & (F.col("confidence") >= DIRECT)))
    clear = q.filter(~unclear)
    terms = _held(terms_of(clear))
    needles = terms.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("term")), 1, 4).alias("needles"))
    codes = clear.select("query_id", F.slice("codes", 1, 3).alias("needles"))
    by_path, by_code = _held(direct_paths(clear, known)), _held(direct_errors(clear, docs))
    direct = _record_claims(by_path.withColumn("score", F.lit(1.0)), known).unionByName(_page_claims(by_code.withColumn("score", F.lit(1.0)).drop("code"), docs, codes))
    direct_ids = by_path.select("query_id").unionByName(by_code.select("query_id")).distinct().withColumn("__direct", F.lit(True))
    gated = _held(undocumented(clear, known, docs).distinct()).withColumn("__gated", F.lit(True))
    routed = q.withColumn("__unclear", unclear).join(direct_ids, "query_id", "left").join(gated, "query_id", "left")
    routed = _held(routed.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("__direct", "__gated")}))
    rest = routed.filter("NOT __unclear AND NOT __direct AND NOT __gated").select(*q.columns)
    asked_terms = terms.join(rest.select("query_id"), "query_id", "left_semi")
    ep = records.search(known, asked_terms, 10 * RECORDS).join(known.select(F.col("record_id").alias("doc_id"), "source"), "doc_id").join(F.broadcast(rest.select("query_id", "sources")), "query_id")  # the stated questions
    ep = ep.filter(F.array_contains("sources", F.col("source"))).withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("order") <= RECORDS)
    ep = _record_claims(_held(ep.select("query_id", "order", F.col("doc_id").alias("record_id"), F.round(intents.bm25_normalized("score"), 9).alias("score"))), known)
    found = _page_claims(_held(searched(rest, asked_terms, docs, registry, semantic, mode, rerank, policy)), docs, needles)
    rows = direct.unionByName(ep.unionByName(found)).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("group", "order", "record_id", "doc_id"))).filter(F.col("r") <= MAX_CLAIMS)
    claim = F.struct(F.concat(F.lit("c"), F.col("r").cast("string")).alias("id"), "kind", "record_id", "doc_id", "url", F.round("score", 6).alias("score"), "excerpt", "excerpt_start", "excerpt_end", "content_hash")
    claims = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", claim.alias("claim")))).alias("c")).select("query_id", F.transform("c", lambda x: x["claim"]).alias("claims"))
    out = routed.join(claims, "query_id", "left")
    status = F.when(F.col("__unclear"), "needs_clarification").when(F.col("claims").isNotNull(), "ok").when(F.col("__gated"), "undocumented").otherwise("not_found")
    route = F.when(F.col("claims").isNotNull(), F.when(F.col("__direct"), "direct").otherwise("search"))
    return out.select("query_id", status.alias("status"), route.alias("route"), F.col("kind").alias("input_type"), "sources", "claims")


def clarification_options(known: DataFrame, registry: DataFrame, most: int = 15) -> DataFrame:
    """(source, name, n_records): the sources with most records, for a question without one. A top-k report."""
    return known.groupBy("source").agg(F.count("*").alias("n_records")).join(registry.select("source", "name").distinct(), "source").orderBy(F.col("n_records").desc(), "source").limit(most).select("source", "name", "n_records")


def derived_differences(claims: DataFrame) -> DataFrame:
    """(query_id, first, second, value): the first claim's weight less the second's, where both excerpts say one. claims: query_id, id, order, excerpt."""
    rows = claims.withColumn("w", extraction.weight(F.col("excerpt"))).filter("order <= 2")
    at = lambda i, c: F.max(F.when(F.col("order") == i, F.col(c)))
    both = rows.groupBy("query_id").agg(at(1, "id").alias("first"), at(2, "id").alias("second"), at(1, "w").alias("a"), at(2, "w").alias("b"))
    return both.filter("a IS NOT NULL AND b IS NOT NULL").select("query_id", "first", "second", (F.col("a") - F.col("b")).alias("value"))


def top_page(questions: DataFrame, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the best page under the question's URL prefix. questions: query_id, prefix; docs: doc_id, url, text."""
    scored = lexical.bm25(docs, terms, {"text": (F.col("text"), 1.0)}).join(docs.select("doc_id", "url"), "doc_id").join(F.broadcast(questions.select("query_id", "prefix")), "query_id")  # the stated questions
    return lexical.top(scored.filter(F.col("url").startswith(F.col("prefix"))).select("query_id", "doc_id", "score"), 1).drop("rank")


def citation_url(documented: Column, found: Column, source: Column) -> Column:
    """What an answer cites for a record: its documentation, unless that is a specification, else the page that was found for it, else its source, unless that is a specification."""
    usable = lambda c: F.when(~matching.is_spec(c), c)
    return F.coalesce(usable(documented), found, usable(source))


def error_pages_first(found: DataFrame, k: int) -> DataFrame:
    """(id, url, position): the first k of id, url, rank; those with "error" in their URL before all others, then by rank and id."""
    first = F.when(F.contains(F.lower(F.coalesce("url", F.lit(""))), F.lit("error")), 0).otherwise(1)
    best = found.select(first.alias("f"), "rank", "id", "url").orderBy("f", "rank", "id").limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy("f", "rank", "id"))).select("id", "url", "position")  # k rows
