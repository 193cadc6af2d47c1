"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

A candidate is a run of 12 or more characters of [A-Za-z0-9+/_-] with a digit in it, or any 8 or more after
"password=", "token=" and the like. Features: its length; the shares of digits, upper and lower case and of hexadecimal
digits; how often neighbouring characters change class, and how many pairs of neighbouring letters are common in words;
the share that words of three or more letters cover, the corpus's WORDS most frequent ones and those of the made findings; whether a path names tests, docs or examples, and whether the
candidate has slashes or dots as paths have; and words beside it that name secrets (token, key, password, ...) or harmless
hashes (commit, sha, uuid, ...). The forest is trained from labelled findings: candidate, before, after, path, label; by
default from findings() below, FINDINGS rows that are made from hashes of their numbers, so training is bounded and the
same everywhere.

Null and empty texts have no candidates and give no rows; very long texts are searched whole. Repeated rows give their
findings each; an empty table gives none. Extra columns pass through, also those that the forest has names for; those named
like a result are replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

FINDINGS = 8_000
NEAR = 48
WORDS = 10_000
WORD_LEAST = 10  # occurrences of a word in the corpus
WORD_SIZES = (3, 16)

_RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{12,}={0,2}"
_NAMED = r"(?<=(?:password|passwd|secret|token|api_key|apikey)[=:])[^\s\"'=:,;]{8,}"
PATTERN = f"{_NAMED}|{_RUN}"

#: Words beside a candidate.
_SECRET_WORDS = r"(?i)(token|secret|passw(or)?d|passwd|api[_-]?key|apikey|access[_-]?key|credential|private|auth|bearer|pwd)[\"']?\s*(=|:|:=|=>|is)?\s*[\"']?$"
_HARMLESS_WORDS = r"(?i)(commit|sha1|sha256|md5|checksum|digest|hash|revision|rev|uuid|guid|build|version|id|ref|blob|tree|etag)[\"']?\s*(=|:|is|of)?\s*[\"']?$"
_COMMON_PAIRS = r"(th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce)"

_MADE_WORDS = "main resources docs guide lib module the quick brown version chapter config section release image your token here example key changeme password secret test dummy".split()

FEATURES = ("f_length", "f_digit", "f_upper", "f_lower", "f_hex", "f_changes", "f_pairs", "f_words", "f_slashes", "f_test_path", "f_secret_word", "f_harmless_word", "f_assigned", "f_quoted", "f_prefix", "f_placeholder")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each candidate: the other columns, start (characters, from 0), candidate, before, after."""
    hit = docs.filter(F.col(f"`{text}`").rlike(PATTERN))
    found = hit.withColumn("__all", F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PATTERN), F.lit(0))).withColumn("__parts", F.split(F.col(f"`{text}`"), PATTERN, -1))
    sizes = F.transform(F.sequence(F.lit(0), F.size("__all") - 1), lambda i: F.struct(
        F.get("__all", i).alias("candidate"), F.right(F.get("__parts", i), F.lit(NEAR)).alias("before"), F.left(F.get("__parts", i + 1), F.lit(NEAR)).alias("after"), F.length(F.get("__parts", i)).alias("gap"), F.length(F.get("__all", i)).alias("size")))
    # the running offset: one fold over the candidates of a text
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), x["candidate"].alias("candidate"), x["before"].alias("before"), x["after"].alias("after"))).alias("out"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,candidate:string,before:string,after:string>>")
    folded = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    keep = [f"`{c}`" for c in docs.columns if c not in (text, "start", "candidate", "before", "after")]
    return found.filter(F.size("__all") > 0).select(*keep, F.inline(folded))


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word): the WORDS most frequent words of a-z alone that occur WORD_LEAST times or more."""
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text}`")), r"[^\p{L}0-9]+")).alias("word")).filter(F.col("word").rlike(f"^[a-z]{{{WORD_SIZES[0]},{WORD_SIZES[1]}}}$"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= WORD_LEAST).orderBy(F.col("n").desc(), "word").limit(WORDS).select("word")


def _covered(rows: DataFrame, words: DataFrame | None) -> DataFrame:
    """Adds __covered: how many of the candidate's letters lie in a word of the dictionary or of the made findings."""
    made = rows.sparkSession.createDataFrame([(w,) for w in _MADE_WORDS], "word string")
    known = (made if words is None else made.unionByName(words)).distinct()
    runs = rows.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))).alias("run")).withColumn("run", F.lower("run"))
    runs = runs.filter(F.length("run") >= WORD_SIZES[0])
    at = runs.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), F.length("run") - WORD_SIZES[0] + 1)).alias("i"))
    parts = at.select("run", "i", F.explode(F.sequence(F.lit(WORD_SIZES[0]), F.least(F.lit(WORD_SIZES[1]), F.length("run") - F.col("i") + 1))).alias("n"))
    hit = parts.withColumn("word", F.substring(F.col("run"), F.col("i"), F.col("n"))).join(F.broadcast(known), "word")  # WORDS rows and the made ones
    letters = hit.select("run", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("at")).distinct().groupBy("run").agg(F.count("*").alias("k"))
    of = runs.join(letters, "run").groupBy("candidate").agg(F.sum("k").alias("__covered"))
    return rows.join(of, "candidate", "left").withColumn("__covered", F.coalesce("__covered", F.lit(0)))


def featured(rows: DataFrame, path: Column | None = None, words: DataFrame | None = None) -> DataFrame:
    """Adds the FEATURES to rows with candidate, before, after."""
    names, rows = rows.columns, _covered(rows, words)
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    changes = F.regexp_count(c, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))
    letters = F.regexp_count(c, F.lit(r"[A-Za-z](?=[A-Za-z])"))
    pairs = F.regexp_count(F.lower(c), F.lit(f"(?={_COMMON_PAIRS})"))
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    where = F.coalesce(path, F.lit("")) if path is not None else F.lit("")
    out = rows.withColumns({
        "f_length": n.cast("double"), "f_digit": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_hex": share("[0-9a-f]"),
        "f_changes": changes / n, "f_pairs": F.when(letters > 0, pairs / letters).otherwise(0.0), "f_words": F.col("__covered") / n,
        "f_slashes": share("[/.\\-]"), "f_test_path": yes(where.rlike(r"(?i)(test|spec|example|doc|fixture|sample|mock)")),
        "f_secret_word": yes(F.col("before").rlike(_SECRET_WORDS)), "f_harmless_word": yes(F.col("before").rlike(_HARMLESS_WORDS)),
        "f_assigned": yes(F.col("before").rlike(r"[=:]\s*[\"']?$")), "f_quoted": yes(F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")),
        "f_prefix": yes(c.rlike(r"^(AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[bap]-|AIza|glpat-|eyJ)")), "f_placeholder": yes(c.rlike(r"(?i)(x{4,}|0{6,}|1234567|abcdef0|example|changeme|your|dummy|test)")),
    })
    return out.select(*(F.col(f"`{x}`") for x in names), *FEATURES)


def findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings: candidate, before, after, path, label; twelve kinds in turn, half of them secrets. One in three lies in a test path, where only keys with a known prefix are secrets."""
    h = F.sha2(F.concat(F.lit("finding-"), F.col("id").cast("string")), 512)
    bits = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
    other = F.sha2(F.concat(F.lit("other-"), F.col("id").cast("string")), 512)
    upper = F.upper(F.translate(F.substring(other, 1, 16), "0123456789", "GHIJ4KLMN7"))
    mixed = F.substring(F.translate(F.base64(F.unhex(other)), "+/=\r\n", "-_"), 1, F.lit(40))
    say = lambda *words: F.element_at(F.array(*(F.lit(w) for w in words)), (bits % len(words) + 1).cast("int"))
    prose = say("the of and", "was ein der", "para los que", "dans le pour", "see the file")
    size = (F.lit(10) + bits % 12).cast("int")
    kinds = [
        (F.substring(h, 1, F.lit(40)), F.concat(prose, say(' token = "', " token: '", ' "token": "')), F.lit('" and'), 1),
        (F.substring(h, 1, size), F.concat(prose, say(" password=", " secret=", " passwd:", " api_key=")), F.lit(" then"), 1),
        (F.concat(say("AKIA", "ASIA", "AKIA"), upper), F.concat(prose, say(" ", " key ", ' access_key = "')), F.lit(" the"), 1),
        (F.concat(say("ghp_", "sk-", "glpat-", "xoxb-"), F.regexp_replace(F.left(mixed, F.lit(32)), "-", "0")), F.concat(prose, say(" ", " bearer ", ' auth: "')), F.lit(" or"), 1),
        (F.left(mixed, F.lit(36)), F.concat(prose, say(' secret = "', " api_key: ", ' credential="')), F.lit('"'), 1),
        (F.substring(h, 1, F.lit(40)), F.concat(prose, say(" ", " commit ", " revision ", " sha1: ")), F.lit(" and"), 0),
        (F.substring(h, 1, F.element_at(F.array(F.lit(32), F.lit(64), F.lit(16), F.lit(12)), (bits % 4 + 1).cast("int"))), F.concat(prose, say(" ", " md5 ", " checksum: ", " in ")), F.lit(" for"), 0),
        (F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.concat(prose, say(" uuid ", " ", ' id: "', " guid=")), F.lit(" is"), 0),
        (F.concat(say("src/main/resources/", "docs/guide/", "lib/module_", "the-quick-brown-", "version-"), say("chapter", "config", "section", "release", "image"), (bits % 1000).cast("string")), F.concat(prose, say(" ", " see ", " file ", ' href="')), F.lit(" for"), 0),
        (F.concat(say("xxxxxxxxxxxx", "your-token-here-", "000000000000", "example-key-", "changeme12345", "1234567890abcdef"), (bits % 100).cast("string")), F.concat(prose, say(' token = "', " password=", " api_key: ")), F.lit('"'), 0),
        (F.translate(F.substring(h, 1, size), "0123456789abcdef", "qzxvkjwbgypmhfdu"), F.concat(prose, say(" password=", " secret=", " token=", " api_key=")), F.lit(" then"), 1),
        (F.concat(say("your", "the", "change", "example"), say("password", "secret", "token", "key"), say("here", "section", "config")), F.concat(prose, say(" password=", " secret=", " token=", " api_key=")), F.lit(" then"), 0),
    ]
    tested = F.conv(F.substring(other, 33, 8), 16, 10).cast("bigint") % 3 == 0
    path = F.when(tested, say("tests/unit/login.py", "docs/guide.md", "examples/run.sh", "spec/fixtures/a.json")).otherwise(say("", "src/main/app.py", "web", "deploy/prod.yml", "notes"))
    label = lambda: F.when(tested & ~(F.col("id") % len(kinds)).isin(2, 3), 0).otherwise(pick(3))
    pick = lambda i: F.element_at(F.array(*(k[i] if i < 3 else F.lit(k[i]) for k in kinds)), (F.col("id") % len(kinds) + 1).cast("int"))
    return spark.range(0, n, 1, 4).select(pick(0).alias("candidate"), pick(1).alias("before"), pick(2).alias("after"), path.alias("path"), label().cast("double").alias("label"))


def train(labelled: DataFrame, words: DataFrame | None = None, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(featured(labelled, F.col("path"), words).repartition(4, "candidate").sortWithinPartitions("candidate", "before", "after", "label"))
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5)
    return forest.fit(rows.select("__features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str | None = None, least: float = 0.5, words: DataFrame | None = None) -> DataFrame:
    """A row for each candidate: the other columns, start, candidate, before, after, probability, is_secret."""
    # written, as the candidates are read for the words they hold and for all else
    found = featured(written(candidates(docs, text), "candidates"), F.col(f"`{path}`") if path else None, words)
    # columns of its own, so that a document's "prediction" or "probability" is in nobody's way
    own = model.copy({model.probabilityCol: "__probability", model.rawPredictionCol: "__raw", model.predictionCol: "__prediction"})
    scored = own.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(found))
    out = scored.withColumn("probability", F.round(vector_to_array(F.col("__probability"))[1], 6))
    return out.withColumn("is_secret", F.col("probability") >= least).drop("__features", "__probability", "__raw", "__prediction", *FEATURES)
