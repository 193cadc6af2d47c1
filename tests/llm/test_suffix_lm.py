"""The suffix tree against one in plain Python that keeps tuples of words, and the edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pagewright.llm import suffix_lm as lm

DOC = "doc_id long, text string, score string, source string"
START, END = "<s>", ""


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", f"s{i}") for i, t in enumerate(texts)], DOC)


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


class Letters:
    """The spelling model: bytes after up to LETTERS bytes before, a blank before and after each distinct word."""

    def __init__(self, types):
        grams = defaultdict(Counter)
        for w in types:
            data = b" " + w.encode() + b" "
            for i in range(1, len(data)):
                for d in range(min(i, lm.LETTERS) + 1):
                    grams[data[i - d : i]][data[i]] += 1
        total = sum(grams[b""].values())
        allowed = [b for b in range(256) if b not in (9, 10, 11, 12, 13)]
        self.p = {b"": {b: (grams[b""][b] + 1) / (total + len(allowed)) for b in allowed}}
        for c in sorted(grams, key=len):
            n = sum(grams[c].values())
            if not c or n < max(1, lm.LETTER_SHARE * total):
                continue
            up = self.p[self.longest(c[1:])]
            if sum(k / n * math.log(k / n / up[b]) for b, k in grams[c].items()) >= lm.LETTER_DIVERGENCE:
                self.p[c] = {b: (grams[c][b] + lm.LETTER_SMOOTH * up[b]) / (n + lm.LETTER_SMOOTH) for b in allowed}

    def longest(self, context):
        while context not in self.p:
            context = context[1:]
        return context

    def word(self, w):
        data, out = b" " + w.encode() + b" ", Decimal(1)
        for i in range(1, len(data)):
            out *= Decimal(self.p[self.longest(data[max(0, i - lm.LETTERS) : i])][data[i]])
        return out


class Tree:
    def __init__(self, texts, depth=lm.DEPTH):
        self.depth, self.after = depth, defaultdict(Counter)
        self.root = Counter()
        for t in texts:
            seq = [START, *words_of(t), END]
            for i in range(1, len(seq)):
                self.root[seq[i]] += 1
                for d in range(1, min(depth, i) + 1):
                    self.after[tuple(seq[i - d : i])][seq[i]] += 1
        self.total, self.types = sum(self.root.values()), len(self.root)
        self.letters = Letters([w for w in self.root if w])
        self.nodes = {c for c, k in self.after.items() if sum(k.values()) >= lm.MIN_COUNT}
        self.kept = {c for c in self.nodes if self.divergence(c) >= lm.DIVERGENCE}

    def smoothed(self, context, w):
        if not context:
            s = self.letters.word(w)
            return (self.root[w] + self.types * s) / (self.total + self.types) if self.total else s
        below = self.smoothed(context[1:], w)
        if context not in self.nodes:
            return below
        k = self.after[context]
        n = sum(k.values())
        return Decimal(max(k[w] - lm.DISCOUNT, 0)) / n + Decimal(lm.DISCOUNT * len(k)) / n * below

    def divergence(self, c):
        n = sum(self.after[c].values())
        return sum(k / n * math.log(k / n / float(self.smoothed(c[1:], w))) for w, k in self.after[c].items())

    def probability(self, before, w):
        for d in range(self.depth, 0, -1):
            c = tuple(before[-d:])
            if len(c) == d and c in self.kept:
                return self.smoothed(c, w)
        return self.smoothed((), w)

    def score(self, text):
        seq = [START, *words_of(text), END]
        return float(sum(self.probability(seq[:i], seq[i]).log10() for i in range(1, len(seq))))


def corpus(n=60):
    rng = random.Random(9)
    common = ["the", "of", "a", "river", "house", "tall", "Ünder", "日本", "run"]
    new = lambda: "".join(rng.choice(["ba", "do", "ki", "ра", "中"]) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(new() if rng.random() < 0.15 else rng.choice(common) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return texts + [None, "", " \n", "The THE the\x0bthe\x1cthe", texts[3], texts[3], "x" * 3_000, "the of " * 2_000]


def test_scores_equal_a_plain_tree_however_texts_are_dealt(spark):
    texts = corpus()
    tree = Tree([t for i, t in enumerate(texts) if i % 3])
    assert 10 < len(tree.kept) < len(tree.after)
    d, train = table(spark, texts), F.col("doc_id") % 3 != 0
    runs = []
    for parts, size, batch in ((1, lm.BLOCK_BYTES, 10_000), (5, 700, 4)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            runs.append({r["doc_id"]: r for r in lm.score(d.repartition(parts), train, block_bytes=size).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, t in enumerate(texts):
        ws = [*words_of(t), END]
        for r in (x[i] for x in runs):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["source"]) == (len(ws), sum(tree.root[w] > 0 for w in ws), tree.total, f"s{i}")
            assert r["base_score"] == pytest.approx(sum(math.log10((tree.root[w] + 1) / (tree.total + tree.types + 1)) for w in ws), abs=1e-6)
            assert r["score"] == pytest.approx(tree.score(t), rel=1e-9, abs=1e-9)
        assert runs[0][i]["score"] == runs[1][i]["score"]


def test_deeper_trees_and_finer_parts_give_the_same(spark, monkeypatch):
    texts = corpus(30)
    monkeypatch.setattr(lm, "FAN_OUT", 3)
    got = {r["doc_id"]: r["score"] for r in lm.score(table(spark, texts), F.lit(True), depth=3, block_bytes=900).collect()}
    tree = Tree(texts, 3)
    assert got == {i: pytest.approx(tree.score(t), rel=1e-9) for i, t in enumerate(texts)}


def test_every_distribution_sums_to_one():
    tree = Tree(corpus(40))
    letters = tree.letters.p
    assert all(sum(p.values()) == pytest.approx(1) for p in letters.values())
    seen = {w: tree.letters.word(w) for w in tree.root}
    new = 1 - sum(seen.values())  # what the spelling gives to all other words
    for c in [(), *sorted(tree.kept)[:200]]:
        known = float(sum(tree.smoothed(c, w) for w in seen))
        other, scale = tree.types / (tree.total + tree.types) * float(new), 1.0
        for d in range(len(c), 0, -1):
            k = tree.after[c[-d:]]
            scale *= lm.DISCOUNT * len(k) / sum(k.values()) if c[-d:] in tree.nodes else 1
        assert known + scale * other == pytest.approx(1)


def test_no_rows_no_training_and_a_better_model_than_the_base(spark):
    texts = corpus()
    d = table(spark, texts)
    none = lm.score(d.limit(0), F.lit(True))
    assert none.count() == 0 and none.columns == ["doc_id", "source", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    untrained = lm.score(d, F.lit(None).cast("boolean")).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in untrained} == {(0, 0)} and all(r["score"] < 0 and r["base_score"] == 0 for r in untrained)
    rng = random.Random(3)
    ring = [f"w{i}" for i in range(50)]
    chain = lambda: " ".join(ring[(s + rng.choice((1, 1, 1, 7)) * k) % 50] for s in [rng.randrange(50)] for k in range(60))
    held = lm.score(table(spark, [chain() for _ in range(80)]), F.col("doc_id") < 60).filter("doc_id >= 60").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_words_are_hashed_apart():
    import numpy as np

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abyz09é") for _ in range(rng.randrange(1, 12))) for _ in range(50_000)} | {"a" * k for k in range(1, 500)})
    first, last, keys = lm.word_keys(np.frombuffer(" \n".join(words).encode(), np.uint8))
    assert len(set(keys.tolist())) == len(words) == len(first)
