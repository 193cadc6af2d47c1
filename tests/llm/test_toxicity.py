"""The noisy channel against an enumeration of every path of its lattice, and edge cases of fitting and scoring."""

import itertools
import math
import random

from pyspark.sql import functions as F

from pagewright.llm import toxicity as tx

DOC = "doc_id long, text string, score string, label string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def letter_cost(counts):
    """Cost of a letter after two others, by the definition: letters, pairs and triples, each smoothed towards the shorter."""
    n = tx._N
    triple = {k: v for k, v in counts.items()}
    whole = sum(triple.values())
    one = [(sum(v for k, v in triple.items() if k % n == c) + 1) / (whole + n) for c in range(n)]

    def two(b, c):
        after = {k: v for k, v in triple.items() if k // n % n == b}
        return (sum(v for k, v in after.items() if k % n == c) + 5 * one[c]) / (sum(after.values()) + 5)

    def three(a, b, c):
        after = {k: v for k, v in triple.items() if k // n == a * n + b}
        return (after.get((a * n + b) * n + c, 0) + 5 * two(b, c)) / (sum(after.values()) + 5)

    return lambda a, b, c: -math.log(three(a, b, c))


def test_decoding_is_the_best_of_all_paths(spark):
    rng = random.Random(15)
    plain = ["idiot", "stupid", "river", "you", "are", "sad", "bad"]
    d = docs(spark, [" ".join(rng.choices(plain, k=8)) for _ in range(40)])
    counts = tx.letter_counts(d)
    restorer, cost = tx.Restorer(counts), letter_cost(counts)
    code = lambda ch: tx._CODE.get(ch, 27)

    def total(path):
        t, a, b = 0.0, 0, 0
        for letters, channel in path:
            t += channel
            for ch in letters:
                if ch == " ":
                    t += cost(a, b, 0)
                    a = b = 0
                else:
                    t += cost(a, b, code(ch))
                    a, b = b, code(ch)
        return t + cost(a, b, 0)

    tokens = ["1d10t", "b.a.d", "b a d", "sssad", "y0u", "s@d!", "r-1-v", "baaad", "u r s 4 d", "!!!"]
    tokens += ["".join(rng.choice("bads140@-. ") for _ in range(rng.randrange(2, 6))) for _ in range(40)]
    for token in tokens:
        lattice = restorer.lattice(token)
        best = min((total(p), "".join(x for x, _ in p)) for p in itertools.product(*lattice))
        got = restorer.decode(token)
        mine = min(total(p) for p in itertools.product(*lattice) if "".join(x for x, _ in p) == got)
        assert abs(mine - best[0]) < 1e-9, (token, got, best)


def test_fit_and_score_edges(spark):
    rng = random.Random(6)
    plain = ["table", "river", "window", "garden"]
    texts = [" ".join(rng.choices(plain, k=10)) + (" idiot" if i % 3 == 0 else "") for i in range(300)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = tx.fit(d, labels)
    again = tx.fit(d.repartition(7), labels.repartition(3))
    assert again.weights.keys() == model.weights.keys() and abs(again.bias - model.bias) < 1e-9
    cases = [None, "", "idiot", "1 d 1 o t", "x" * 50_000, "word " * 40_000 + "i.d.i.o.t", "same idiot", "same idiot"]
    got = [r["result"] for r in sorted(tx.score(docs(spark, cases, [None, 1, 2, 3, 4, 5, 6, 6]), model, column="result").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))]
    assert got[0] == got[1] and got[6] == got[7] and [x >= 0.5 for x in got] == [False, False, True, True, False, True, True, True]
    scored = tx.score(d, model)
    assert scored.columns == ["doc_id", "text", "label", "score"] and scored.schema["score"].dataType.simpleString() == "double"
    assert tx.score(d.limit(0), model).count() == 0
    empty = tx.fit(d.limit(0), labels)
    assert {r["score"] for r in tx.score(d.limit(2), empty).collect()} == {0.0}
    assert tx.fit(d, labels.select("doc_id", F.lit(1).alias("toxic"))).bias == -math.inf
