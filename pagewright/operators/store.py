"""Store reports, snapshots and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, **equal) -> DataFrame:
    """Equality on each column that is given a value."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def ilike_filter(df: DataFrame, column: str, part: str) -> DataFrame:
    """Letter case aside; % and _ in the part stay wildcards."""
    return df.filter(F.col(column).ilike(f"%{part}%"))


def stale(ts: Column, as_of: Column, days: float) -> Column:
    """More than so many days old, by the fraction of a day."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000 > days


def counts_by(df: DataFrame, *keys: str, name: str = "n", **more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name), *(c.alias(k) for k, c in more.items()))


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """One pass with a bounded heap in each task."""
    return df.orderBy(*order).limit(k)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by `order`; a maximum, so partial aggregation does most of it."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col(f"__last.{c}").alias(c) for c in (*order, *rest)))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def inventory_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: added, removed, kept. One shuffle of both sides on the key."""
    (key,) = old.columns
    sides = old.withColumn("side", F.lit(1)).unionByName(new.withColumn("side", F.lit(2)))
    flags = sides.groupBy(key).agg(F.bit_or("side").alias("sides"))
    return flags.agg(F.count_if(F.col("sides") == 2).alias("added"), F.count_if(F.col("sides") == 1).alias("removed"), F.count_if(F.col("sides") == 3).alias("kept"))


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a, only_b, both, coverage_pct (100 if b is empty)."""
    d = inventory_diff(a, b).select(F.col("removed").alias("only_a"), F.col("added").alias("only_b"), F.col("kept").alias("both"))
    total = F.col("only_b") + F.col("both")
    return d.withColumn("coverage_pct", F.when(total == 0, 100.0).otherwise(F.round(100.0 * F.col("both") / total, 2)))


def with_provenance(found: DataFrame, key: str, method: str, order: str) -> DataFrame:
    """For each key the methods that found it, and the first of them."""
    return found.groupBy(key).agg(F.array_sort(F.collect_set(method)).alias("methods"), F.min_by(method, order).alias("first_seen_via"))


def inventory_hash(urls: DataFrame, url: str = "url") -> DataFrame:
    """SHA-256 of the sorted distinct URLs, joined by a backslash and an n."""
    return urls.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(url)), "\\n"), 256).alias("inventory_hash"))


def version_diff(versions: DataFrame, runs: tuple[int, int], key: str = "key", run: str = "run", digest: str = "digest") -> DataFrame:
    """One row: new, updated, unchanged, stale of the second run against the first."""
    at = lambda r: F.max(F.when(F.col(run) == r, F.col(digest)))
    both = versions.filter(F.col(run).isin(*runs)).groupBy(key).agg(at(runs[0]).alias("a"), at(runs[1]).alias("b"))
    return both.agg(
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("new"), F.count_if(F.col("a") != F.col("b")).alias("updated"),
        F.count_if(F.col("a") == F.col("b")).alias("unchanged"), F.count_if(F.col("b").isNull()).alias("stale"),
    )


def scope_ownership(claims: DataFrame) -> DataFrame:
    """(scope, url, owner, priority): the owner of the least priority number; of equals the first claim."""
    best = F.min(F.struct("priority", "seq", "owner")).alias("b")
    return claims.groupBy("scope", "url").agg(best).select("scope", "url", F.col("b.owner").alias("owner"), F.col("b.priority").alias("priority"))


def scope_skips(entries: DataFrame, ownership: DataFrame) -> DataFrame:
    """Entries (scope, url, owner, priority) that another owner of no greater priority number holds."""
    held = ownership.select("scope", "url", F.col("owner").alias("__o"), F.col("priority").alias("__p"))
    return entries.join(held, ["scope", "url"]).filter((F.col("__o") != F.col("owner")) & (F.col("__p") <= F.col("priority"))).drop("__o", "__p")


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming to append: new keys, each once (the least row)."""
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)) if rest else incoming.distinct()
    return once.join(existing.select(*keys), keys, "left_anti")


def hash_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows by a seeded hash: the same rows at every run. A sampling operator."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def previous(df: DataFrame, keys: list[str], order: list, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def coverage_by_section(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """(section, n_discovered, n_stored, n_both, pct): pct is 100 where nothing was discovered. Both: section, url."""
    both = discovered.distinct().withColumn("d", F.lit(1)).join(stored.distinct().withColumn("s", F.lit(1)), ["section", "url"], "full")
    sums = both.groupBy("section").agg(F.count("d").alias("n_discovered"), F.count("s").alias("n_stored"), F.count(F.when(F.col("d").isNotNull() & F.col("s").isNotNull(), 1)).alias("n_both"))
    return sums.withColumn("pct", F.when(F.col("n_discovered") == 0, 100.0).otherwise(F.round(100.0 * F.col("n_both") / F.col("n_discovered"), 2)))


def http_bucket(status: Column) -> Column:
    return F.when(status.isNull() | (status == 0), "network_error").when(status.between(200, 299), "ok").when(status.between(300, 399), "redirect").when(status.between(400, 499), "client_error").otherwise("other")
