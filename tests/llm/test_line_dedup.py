"""Line dedup against a program of its own that looks at every run of every text."""

import random
import re

from pagewright.llm import line_dedup as ld

DOC = "doc_id long, text string, n_lines string"


def lines_of(text):
    """Cut behind line ends and behind sentence ends with their blanks."""
    out, at = [], 0
    for m in re.finditer(r"\n|[.!?]+[ \t]+", text):
        out.append(text[at : m.end()])
        at = m.end()
    return [x for x in [*out, text[at:]] if x]


def expected(rows, least):
    """For each (id, text) the text without lines that lie in a run of `least` words or more that stands at an earlier place."""
    order = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for key in order:
        parts = lines_of(key[1] or "")
        full = [i for i, p in enumerate(parts) if p.split()]
        words = [tuple(parts[i].split()) for i in full]
        gone = set()
        for i in range(len(words)):
            n = 0
            for j in range(i, len(words)):
                n += len(words[j])
                run = tuple(words[i : j + 1])
                if n < least:
                    continue
                if run in seen:
                    gone |= set(range(i, j + 1))
                seen.add(run)
        drop = {full[i] for i in gone}
        out[key] = "".join(p for i, p in enumerate(parts) if i not in drop) if drop else key[1]
    return out


def got(spark, rows, least, parts=3):
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOC).repartition(parts)
    return {(r["doc_id"], r["n_removed"], r["text"]) for r in ld.dedup_lines(d, least=least).collect()}


def test_a_line_that_stands_alone_earlier_hides_no_copy(spark):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(10)) + "\n"
    a, middle, b = line(1), line(2), line(3)
    rows = [(1, middle), (5, "x y\n" + a + middle + b), (9, a + middle + b + "z\n")]
    assert got(spark, rows, 30) == {(1, 0, middle), (5, 0, rows[1][1]), (9, 3, "z\n")}


def test_equals_a_search_of_all_places(spark):
    rng = random.Random(8)
    short = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 4))) for _ in range(8)]
    passages = ["".join(rng.choice(short) + rng.choice(["\n", ". ", "! \t", "\n\n"]) for _ in range(rng.randrange(2, 8))) for _ in range(6)]
    rows = []
    for i in range(60):
        body = "".join(rng.choice([rng.choice(short) + "\n", rng.choice(passages), f"own {i} {rng.random()}\n"]) for _ in range(rng.randrange(1, 10)))
        rows.append((rng.choice([None, i % 25, i]), body))
    # ids that repeat would need the hash that orders their texts: each id has one text here
    rows = list({i: (i, t) for i, t in rows}.values()) + [(100, None), (101, ""), (102, " \n\t\n"), (103, "a b c d\n" * 50), (104, "long " * 30_000)]
    for least in (4, 6):
        want = expected(rows, least)
        result = {(i, t) for i, _, t in got(spark, rows, least)}
        assert result == {(k[0], v) for k, v in want.items()}


def test_repeated_rows_and_empty_tables(spark):
    text = "\n".join(" ".join(f"q{i}{j}" for j in range(8)) for i in range(6))
    twice = got(spark, [(1, text), (1, text), (2, text)], 30)
    assert twice == {(1, 0, text), (2, 6, "")}
    d = spark.createDataFrame([], DOC)
    out = ld.dedup_lines(d)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_lines", "n_removed", "removed_words"]
