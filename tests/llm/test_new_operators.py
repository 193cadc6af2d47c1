"""Periodic runs, sharding and product codes against brute force, and their edge cases."""

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import periodic, product_codes, queries, sharding

LONG = "lorem ipsum dolor " * 20_000


def all_runs(w, least, exponent):
    """Every stretch with a smallest period, from all periods and all starts."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            end = i
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            length = end + q - i
            x = w[i : i + length]
            smallest = next(p for p in range(1, q + 1) if all(x[k] == x[k + p] for k in range(length - p)))
            if smallest == q and length >= least and length >= exponent * q:
                out.append((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng, n):
    letters = rng.choice(["ab", "abc", "abcdefgh"])
    out = []
    while len(out) < n:
        if rng.random() < 0.4:
            part = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
            out += (part * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        else:
            out.append(rng.choice(letters))
    return out[:n]


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (2, 2), (6, 2), (9, 4)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(150):
        words = [w.encode() for w in random_words(rng, rng.randrange(0, 130))]
        want = all_runs(words, least, exponent)
        ids = {}
        assert periodic.runs_of([ids.setdefault(w, len(ids)) for w in words], least, exponent) == want
        assert periodic.find_runs(words, least, exponent) == want


def test_classes_are_those_of_equal_factors():
    rng = random.Random(4)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        parts = periodic.Partition(s, len(s))
        moved = 0
        for k in range(1, len(s) + 1):
            groups = defaultdict(list)
            for i in range(len(s) - k + 1):
                groups[tuple(s[i : i + k])].append(i)
            for g in groups.values():
                assert len({parts.of[i] for i in g}) == 1 and parts._members(parts.of[g[0]]) == g
            assert len({parts.of[i] for i in range(len(s) - k + 1)}) == len(groups)
            moved += sum(map(len, parts.small))
            parts.refine()
        assert moved <= (len(s) + 1) * (math.log2(len(s) + 1) + 1)


def plant(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \t", "one", LONG, *(" \n"[i % 2].join(random_words(rng, rng.randrange(1, 160))) for i in range(300))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = plant([w.decode() for w in (t or "").encode().split()], i)
        runs = [(0, 60_000, 3)] if t == LONG and zlib.crc32(str(i).encode()) % 10 else all_runs(words, 24, 3)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 100


def test_periodic_edges(spark):
    d = spark.createDataFrame([(None, None, "clash", "x"), (1, LONG, "clash", "y"), (1, LONG, "clash", "z")], "doc_id long, text string, runs string, extra string")
    rows = sorted(periodic.periodic_runs(d).collect(), key=lambda r: r["extra"])
    assert [(r["n_runs"], r["collapsed"]) for r in rows] == [(0, ""), (1, "lorem ipsum dolor"), (1, "lorem ipsum dolor")] and rows[0]["longest"] is None
    assert periodic.periodic_runs(d.limit(0)).count() == 0


def plain_lpt(sizes, shards):
    heap, loads = [(0, s) for s in range(shards)], [0] * shards
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        loads[s] = load + size
        heapq.heappush(heap, (load + size, s))
    return loads


def test_dealing_by_classes_is_the_heap():
    rng = random.Random(6)
    for shards in (1, 3, 40):
        sizes = [rng.choice([17, 18, 19, 20, 21, 100, 101, 3000, 4000]) for _ in range(rng.randrange(0, 4000))] + [50_000] * 3
        counts = Counter(sizes)
        loads = [0] * shards
        for size in sorted(counts, reverse=True):
            before = list(loads)
            got = sharding.deal(loads, counts[size], size)
            assert sum(got) == counts[size] and loads == [b + n * size for b, n in zip(before, got)]
        assert loads == plain_lpt(sizes, shards)
    assert sharding.deal([5, 0, 5], 4, 0) == [0, 4, 0]


def test_classes_name_the_shards_that_get_groups():
    classes = [(40, 2, 80), (9, 5, 45), (1, 100, 100)]
    assert sharding.schedule(classes, 3) == [(40, [0, 1], [1, 2]), (9, [2], [5]), (1, [0, 1, 2], [35, 70, 100])]


def check_shards(rows, shards):
    slots, of = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(r["digest"], r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards(spark, monkeypatch):
    rng = random.Random(7)
    texts = [None, "", LONG, *["hot text " * 40] * 700, *("".join(rng.choice("abü ") for _ in range(int(rng.paretovariate(0.7) * 20) % 9000)) for _ in range(1500))]
    d = spark.createDataFrame([(i if i % 50 else None, t, "clash", i) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 3)] * 4, "doc_id long, text string, slot string, extra long")
    want = Counter((t, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in [*texts, *[texts[3]] * 4])
    totals = Counter()
    for (t, size, _), n in want.items():
        totals[t] += size * n
    loads = plain_lpt(totals.values(), 40)
    found = []
    for bucket in (200_000, 50):  # ranks do not depend on the number of buckets
        monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
        out = sharding.shard_documents(d.withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("null"))).repartition(7 if bucket == 50 else 3))
        rows = out.collect()
        check_shards(rows, 40)
        assert len(rows) == len(texts) + 4 and "text" not in out.columns
        assert Counter((r["digest"], r["size"], r["text_crc32"]) for r in rows) == Counter({(hashlib.sha256(t.encode()).hexdigest() if t is not None else "null", s, c): n for (t, s, c), n in want.items()})
        got = [0] * 40
        for r in rows:
            got[r["shard"]] += r["size"]
        # the classes' means are off by less than a 2,048th of a size
        assert max(abs(a - b) for a, b in zip(sorted(got), sorted(loads))) <= max(loads) / 2048 + min(totals.values())
        found.append({(r["extra"], r["shard"], r["slot"]) for r in rows if r["extra"] > 3 and r["doc_id"] is not None})
    assert found[0] == found[1]
    assert sharding.shard_documents(d.limit(0)).count() == 0


def test_small_sizes_are_dealt_as_the_heap_does(spark):
    texts = ["x" * (i % 977) + str(i) for i in range(3_000)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 7).collect()
    got = Counter()
    for r in rows:
        got[r["shard"]] += r["size"]
    assert [got[s] for s in range(7)] == plain_lpt([len(t) + 16 for t in texts], 7)


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    w = len(x[0]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for v in x[:entries]] for p in range(parts)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, z)), e) for e, z in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v in x:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, ys in members.items():
                books[p][e] = [sum(c) // len(ys) for c in zip(*ys)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for v in x]
    return [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize(("n", "width"), [(150, 32), (20, 16), (90, 48)])
def test_product_codes_equal_brute_force(spark, n, width):
    rng = random.Random(n)
    vectors = [[round(rng.gauss(0, 0.3), 2) for _ in range(width)] for _ in range(n)]
    vectors[n // 2] = vectors[1]
    labels = [rng.choice([None, 1, 1, 1, 2]) for _ in range(n)]
    bad = [None, [math.nan] * width, [math.inf] + [0.0] * (width - 1), [None] + [0.0] * (width - 1), [0.0] * (width - 1), [1e30] * width]
    rows = [(2 * i - 7, v, k, "clash", "x") for i, (v, k) in enumerate(zip(vectors, labels))] + [(-100 if k in (0, 1) else 10_000 + k, b, 1, "clash", "bad") for k, b in enumerate(bad)]
    rng.shuffle(rows)
    got = product_codes.product_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, extra string").repartition(5))
    codes, digest = plain_codes([np.float32(v).tolist() for v in vectors])
    errors = Counter()
    for k, (_, e) in zip(labels, codes):
        errors[k] += e
    want = {(2 * i - 7, c, e, errors[k], digest, "x") for i, (k, (c, e)) in enumerate(zip(labels, codes))}
    found = got.select("vec_id", "code", "error", "label_error", "codebooks_sha256", "extra").collect()
    assert len(found) == n and set(map(tuple, found)) == want


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(8)
    for width in (1, 4, 9):
        parts, entries = rng.integers(-6, 6, (400, width)), rng.integers(-6, 6, (64, width))
        whole = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = product_codes.nearest(parts, entries)
        assert (index == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()


def test_product_codes_edges(spark):
    schema = "vec_id long, embedding array<double>, label string"
    for rows in ([], [(1, None, "a")], [(1, [1.0, 2.0], "a")], [(1, [], "a")]):
        assert product_codes.product_codes(spark.createDataFrame(rows, schema)).count() == 0
    one = product_codes.product_codes(spark.createDataFrame([(None, [0.5] * 32, None)] * 3, schema)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 16, 0, 0)] * 3
