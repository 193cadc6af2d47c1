"""Inventories: what to fetch next, politeness, link closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pages as page_functions
from ..functions import urls
from ..sources import formats, places

#: Where sitemaps usually are, at the root and below a path.
ROOT_SITEMAPS = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap.xml.gz", "sitemap/sitemap.xml", "sitemaps.xml")
PATH_SITEMAPS = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap.xml.gz")


def sitemap_candidates(seeds: DataFrame, url: str = "url", ancestors: int = 3) -> DataFrame:
    """(url): candidates at the root and below up to three ancestors of each seed's path."""
    scheme, host = urls.part(url, 1), urls.part(url, 2)
    parts = F.filter(F.split(urls.part(url, 3), "/"), lambda s: s != "")
    root = F.concat(scheme, F.lit("://"), host, F.lit("/"))
    levels = F.slice(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(root, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))), 2, ancestors)
    found = F.concat(F.array(*(F.concat(root, F.lit(n)) for n in ROOT_SITEMAPS)), F.flatten(F.transform(levels, lambda p: F.array(*(F.concat(p, F.lit(n)) for n in PATH_SITEMAPS)))))
    return seeds.select(F.explode(found).alias("url")).distinct()


def robots_policy(status: Column) -> Column:
    """parse for 2xx, allow_all for 4xx, else deny_all."""
    return F.when(status.between(200, 299), "parse").when(status.between(400, 499), "allow_all").otherwise("deny_all")


def robots_sitemaps(robots: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(robots, F.lit(r"(?mi)^\s*sitemap\s*:\s*(\S+)"), F.lit(1)))


def to_fetch(entries: DataFrame, resume: bool) -> DataFrame:
    """Entries of a run: all, or for a resumed one those that are pending, in error or skipped."""
    return entries.filter(F.col("status").isin("pending", "error", "skipped")) if resume else entries


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait: digits, or an HTTP date less now; never below 0; null for anything else."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).try_cast("double")).otherwise(F.greatest(F.lit(0.0), (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double")))


def truncated(size: Column, most: Column, declared: Column) -> Column:
    """95 % of the limit or more, or less than was declared."""
    return (size >= 0.95 * most) | F.coalesce(declared > size, F.lit(False))


CHUNK = 4_096  # log rows of a domain that are folded at once


def adaptive_delay(log: DataFrame, base: float = 1.0, most: float = 60.0) -> DataFrame:
    """(domain, seq, delay): 429 doubles the delay, 500 and above make it half as much again, all else takes a tenth off; within [base, most]. log: domain, seq (each once in a domain), status.

    A step is x -> min(max(m x, low), high), and so is any run of steps. Chunks of CHUNK numbers are therefore folded into
    one step each, a domain's chunks give each chunk its first delay, and chunks are played from there: no task holds more
    than a chunk of a domain's log, or one row a chunk.
    """
    step = F.when(F.col("status") == 429, 2.0).when(F.col("status") >= 500, 1.5).otherwise(0.9)
    rows = log.select("domain", F.col("seq").cast("bigint").alias("seq"), F.coalesce(step, F.lit(0.9)).alias("m"), F.floor(F.col("seq") / CHUNK).alias("chunk"))
    chunks = rows.groupBy("domain", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "m"))).alias("steps"))
    clamp = lambda x, low, high: F.least(F.greatest(x, low), high)
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("low"), F.lit(1e300).alias("high"))
    then = lambda a, m, low, high: F.struct((a["m"] * m).alias("m"), clamp(a["low"] * m, low, high).alias("low"), clamp(a["high"] * m, low, high).alias("high"))
    folded = F.aggregate("steps", start, lambda a, x: then(a, x["m"], F.lit(base), F.lit(most)))
    runs = chunks.select("domain", "chunk", folded.alias("f")).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("runs"))
    first = F.struct(F.lit(base).alias("x"), F.array().cast("array<struct<chunk:bigint,first:double>>").alias("out"))
    step_on = lambda a, r: F.struct(clamp(a["x"] * r["f"]["m"], r["f"]["low"], r["f"]["high"]).alias("x"), F.array_append(a["out"], F.struct(r["chunk"].alias("chunk"), a["x"].alias("first"))).alias("out"))
    firsts = runs.select("domain", F.inline(F.aggregate("runs", first, step_on, lambda a: a["out"])))
    played = F.struct(F.col("first").alias("x"), F.array().cast("array<struct<seq:bigint,delay:double>>").alias("out"))
    one = lambda a, x: F.struct(clamp(a["x"] * x["m"], F.lit(base), F.lit(most)).alias("x"), F.array_append(a["out"], F.struct(x["seq"].alias("seq"), clamp(a["x"] * x["m"], F.lit(base), F.lit(most)).alias("delay"))).alias("out"))
    return chunks.join(firsts, ["domain", "chunk"]).select("domain", F.inline(F.aggregate("steps", played, one, lambda a: a["out"])))


def scope_prefixes(seeds: Column) -> Column:
    """The folders of the canonical seeds, sorted, each once."""
    folder = lambda u: F.regexp_replace(F.regexp_replace(urls.canonical(u), r"\?.*$", ""), r"[^/]*$", "")
    return F.array_sort(F.array_distinct(F.transform(F.filter(seeds, lambda u: F.length(u) > 0), folder)))


def _held(df: DataFrame, name: str) -> DataFrame:
    """A step's rows, written to the shared folder, so that later steps don't plan and run it again."""
    path = places.fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sitemap_walk(fetched: DataFrame, seeds: DataFrame, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(pages (url, lastmod), errors (url, error)) from sitemaps that were fetched before: indexes lead to their children, level by level, each sitemap once by its canonical form. fetched: url, status, content_type, body (bytes); seeds: url. ESITEMAPHTTP for a status outside 2xx, ESITEMAPFORMAT for what is no XML; sitemaps that were not fetched are in neither."""
    there = fetched.select(urls.canonical("url").alias("__c"), "url", "status", "content_type", formats.sitemap_bytes(F.col("body")).alias("xml"))
    bad = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "ESITEMAPHTTP").when(~F.lower(F.coalesce("content_type", F.lit(""))).contains("xml") & ~F.ltrim(F.coalesce("xml", F.lit(""))).startswith("<"), "ESITEMAPFORMAT")
    there = there.withColumn("error", bad).withColumn("entries", F.when(F.col("error").isNull(), formats.sitemap_urls(F.col("xml"))))
    # each sitemap is parsed once; a level reads the indexes' links and the level before
    there = _held(there.select("__c", "url", "error", "entries"), "sitemaps")
    links = _held(there.select("__c", F.explode(F.filter("entries", lambda e: e["is_index"])).alias("e")).select("__c", urls.canonical("e.loc").alias("child")), "sitemaps")
    frontier = _held(seeds.select(urls.canonical("url").alias("__c")).distinct(), "sitemaps")
    seen = frontier
    for _ in range(depth - 1):
        children = links.join(frontier, "__c").select(F.col("child").alias("__c")).distinct()
        frontier = _held(children.join(seen, "__c", "left_anti"), "sitemaps")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    visited = there.join(seen, "__c")
    found = visited.select(F.inline("entries")).filter(~F.col("is_index") & F.col("loc").rlike("^https?://"))
    return found.groupBy(F.col("loc").alias("url")).agg(F.max("lastmod").alias("lastmod")), visited.filter("error IS NOT NULL").select("url", "error")


FEW = 5  # so few URLs from sitemaps make links count too


def created(candidates: DataFrame, links: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries (section, url, status), inventories (section, url_count, inventory_hash)) of each section: its sitemaps' URLs, where they are fewer than FEW also the links found on its pages, canonical, on its domains, in its scope, and its seeds. candidates, links: section, url; sections: section, domains, seeds, prefixes (null: the seeds' folders)."""
    scope = sections.select("section", "domains", "seeds", F.coalesce("prefixes", scope_prefixes(F.col("seeds"))).alias("prefixes"))
    enough = candidates.groupBy("section").agg(F.countDistinct("url").alias("n")).filter(F.col("n") >= FEW).select("section")
    offered = candidates.select("section", "url").unionByName(links.select("section", "url").join(enough, "section", "left_anti"))
    judged = offered.filter(urls.rejection("url").isNull()).select("section", urls.canonical("url").alias("url")).distinct().join(scope, "section")
    own = F.exists("domains", lambda d: (urls.host("url") == d) | urls.host("url").endswith(F.concat(F.lit("."), d)))
    within = (F.size("prefixes") == 0) | F.exists("prefixes", lambda p: F.col("url").startswith(p))
    seeded = scope.select("section", F.explode("seeds").alias("seed")).select("section", urls.canonical("seed").alias("url"))
    entries = judged.filter(own & within).select("section", "url").unionByName(seeded).distinct().withColumn("status", F.lit("pending"))
    # a section's list of URLs is hashed as one text, as the stored hashes are
    inventories = entries.groupBy("section").agg(F.count("*").alias("url_count"), F.sha2(F.array_join(F.array_sort(F.collect_list("url")), "\\n"), 256).alias("inventory_hash"))
    return entries, inventories


def fetch_plan(entries: DataFrame, ownership: DataFrame, robots: DataFrame, pages: DataFrame, resume: bool = False) -> DataFrame:
    """(section, url, action, etag, last_modified): what a run does with each entry. skip_scope where another owner of no greater priority number has the URL, skip_robots where robots.txt forbids it, else revalidate with the stored etag or date, or fetch. entries: section, url, status, scope, owner, priority; ownership: scope, url, owner, priority; robots: host, status, robots; pages: url, etag, last_modified."""
    rows = to_fetch(entries, resume)
    held = ownership.select("scope", "url", F.col("owner").alias("__o"), F.col("priority").alias("__p"))
    rows = rows.join(held, ["scope", "url"], "left").withColumn("host", urls.host("url"))
    rows = rows.join(robots.select("host", F.col("status").alias("__s"), "robots"), "host", "left").join(pages.select("url", "etag", "last_modified"), "url", "left")
    theirs = F.coalesce((F.col("__o") != F.col("owner")) & (F.col("__p") <= F.col("priority")), F.lit(False))
    path = F.concat(urls.part("url", 3), F.when(urls.part("url", 4) != "", F.concat(F.lit("?"), urls.part("url", 4))).otherwise(""))
    allowed = page_functions.robots_allowed(F.coalesce("__s", F.lit(0)), F.coalesce("robots", F.lit("")), path)
    known = F.col("etag").isNotNull() | F.col("last_modified").isNotNull()
    action = F.when(theirs, "skip_scope").when(~allowed, "skip_robots").when(known, "revalidate").otherwise("fetch")
    return rows.select("section", "url", action.alias("action"), "etag", "last_modified")


def backfill(inventories: DataFrame, entries: DataFrame, discovered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new entries (inventory_id, url, status), recounted (inventory_id, url_count)): discovered URLs that the latest inventory of their section lacks, as pending. inventories: inventory_id, section, generated_at; entries: inventory_id, url; discovered: section, url."""
    latest = inventories.groupBy("section").agg(F.max(F.struct("generated_at", "inventory_id")).alias("l")).select("section", F.col("l.inventory_id").alias("inventory_id"))
    wanted = discovered.select("section", "url").distinct().join(latest, "section").select("inventory_id", "url")
    new = wanted.join(entries.select("inventory_id", "url"), ["inventory_id", "url"], "left_anti").withColumn("status", F.lit("pending"))
    counts = entries.select("inventory_id", "url").join(latest.select("inventory_id"), "inventory_id", "left_semi").unionByName(new.select("inventory_id", "url")).groupBy("inventory_id").agg(F.count("*").alias("url_count"))
    return new, counts


def fetch_verdicts(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """(check, url, ok, reason): seeds, base URLs, sitemaps and links against a fetch log. wanted: check, url; log: url, status, content_type, final_url, domains (those the answer may come from, null: any). Of several answers the one with the least status counts."""
    answers = log.groupBy(urls.canonical("url").alias("__c")).agg(F.min(F.struct("status", "content_type", "final_url", "domains")).alias("a")).select("__c", "a.*")
    rows = wanted.withColumn("__c", urls.canonical("url")).join(answers, "__c", "left")
    away = F.col("domains").isNotNull() & ~F.exists("domains", lambda d: (urls.host("final_url") == d) | urls.host("final_url").endswith(F.concat(F.lit("."), d)))
    reason = (
        F.when(F.col("status").isNull() | (F.col("status") == 0), "no_answer").when(~F.col("status").between(200, 299), F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(F.coalesce(away, F.lit(False)), "left_domain").when((F.col("check") == "sitemap") & ~F.lower(F.coalesce("content_type", F.lit(""))).contains("xml"), "not_xml")
    )
    return rows.select("check", "url", reason.isNull().alias("ok"), reason.alias("reason"))


def reachable(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes at most `depth` links from a seed, by their least depth. links: src, dst; seeds: node. Each step joins the new nodes alone."""
    frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for d in range(1, depth + 1):
        step = links.join(frontier, links.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def ordered_frontier(links: DataFrame, seeds: DataFrame, max_pages: int = 5_000, max_queue: int | None = None, rounds: int = 50) -> DataFrame:
    """(section, url, round, visit): the pages that a crawl in lexicographic order visits, by rounds, with its budgets.

    In a round a section's queued pages are visited in their URLs' order until max_pages are reached; what they link to is
    queued in its order until max_queue (20 * max_pages, 200,000 at most) are queued; the rest is dropped. visit numbers a
    section's visits from 1 and is null for pages that were queued only. links: section, src, dst; seeds: section, url.
    A section has max_queue rows at most, so its ranks are counted within one task each; more candidates than that are cut
    within the tasks that find them. Each round is written before the next one begins.
    """
    most = max_queue or min(20 * max_pages, 200_000)
    by_url = Window.partitionBy("section").orderBy("url")

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.row_number().over(by_url)).filter(F.col(name) <= most)

    first = ranked(seeds.select("section", "url").filter(F.col("url").isNotNull()).distinct(), "__q")
    queued = _held(first.select("section", "url", F.lit(0).alias("round"), F.lit(None).cast("int").alias("visit")), "frontier")
    edges = links.select("section", F.col("src").alias("url"), "dst")
    for r in range(1, rounds + 1):
        counts = queued.groupBy("section").agg(F.count("*").alias("__queued"), F.count("visit").alias("__visited"), F.max("round").alias("__last"))
        # pages of the last round are the only ones that were never looked at
        fresh = queued.filter(F.col("round") == r - 1).withColumn("__k", F.row_number().over(by_url)).join(counts, "section")
        order = (F.col("__visited") + F.col("__k")).cast("int")
        visited = fresh.withColumn("visit", F.when(order <= max_pages, order)).select("section", "url", "round", "visit")
        found = edges.join(visited.filter(F.col("visit").isNotNull()), ["section", "url"], "left_semi").select("section", F.col("dst").alias("url")).filter(F.col("url").isNotNull()).distinct()
        new = ranked(found.join(queued.select("section", "url"), ["section", "url"], "left_anti"), "__q").join(counts, "section").filter(F.col("__queued") + F.col("__q") <= most)
        before = queued.filter(F.col("round") < r - 1)
        queued = _held(before.unionByName(visited).unionByName(new.select("section", "url", F.lit(r).alias("round"), F.lit(None).cast("int").alias("visit"))), "frontier")
        if queued.filter(F.col("round") == r).isEmpty():
            break
    return queued
