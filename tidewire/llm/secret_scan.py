"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values assigned to a word (``password=...``), long runs of
token characters and private key blocks. Features of a candidate:

- length, and its characters: transitions between classes (lower, upper,
  digit, other), shares of digits and capitals, entropy, and how usual its
  letter pairs are in the corpus;
- dictionary coverage: the share of its characters inside dictionary words.
  The dictionary is every word of 3 to 15 letters that occurs ``WORD_COUNT``
  times or more in all documents, values that are assigned to something left
  out, so that no password is a word by being copied. A word of 16 letters
  is a candidate itself. Words are counted in a table and joined with the
  parts of the candidates' letter runs; none of them goes to the driver;
- path: whether the document's path speaks of tests and samples, or of
  configuration and credentials, and whether the candidate is part of a URL or path;
- neighbouring words: a credential word before it, an assignment, quotes,
  and words such as ``checksum`` or ``example`` nearby.

The forest is fitted on labelled findings, at most ``TRAINING_ROWS`` of
them by a hash, half for each label. Equal findings of copies are one with
a weight of 1 + ln(copies), so that a large group of copies neither fills
the sample nor outweighs all others. Where no labels are given, the findings
are those of ``planted``: texts made from the corpus's own frequent words, with
a finding of a known kind put into each. Its label says what was planted and
where, and follows from no single feature: the same random string is a
secret behind a credential word in a deployment file, and none behind
``commit``, next to ``example`` or in a test's file.

Defined cases: a null text has no candidate; a null path is an empty one.
With labelled findings of one kind only, that kind decides, and with an
empty labelled table every candidate is a secret, so nothing is let through
unseen. Equal texts with equal paths have equal findings. Candidates don't
overlap: key blocks go before assigned values, and those before runs. Only
the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, trimmed, written

#: A dictionary word occurs so often at least and has so many letters.
WORD_COUNT, WORD_LETTERS = 5, (3, 15)
#: Frequent words that planted texts are made of.
PLANTED_WORDS = 2_000
#: Labelled findings that the forest is fitted on, at most.
TRAINING_ROWS = 4_000
TREES, DEPTH, SEED = 24, 6, 7
#: Characters of context on either side of a candidate.
AROUND = 40
#: Texts in a batch between Spark and Python.
BATCH = 1000
#: Starts of words in a piece of a long run of letters.
PIECE = 512
CUTOFF = 0.5
MASK = "[SECRET]"

# Credential words, words that speak against, path words, providers' prefixes.
CREDENTIAL_WORDS = "access_key api_key apikey auth bearer credential passphrase passwd password private_key pwd secret token".split()
HARMLESS_WORDS = "checksum commit digest dummy example hash md5 placeholder sample sha1 sha256 uuid".split()
TEST_PATHS = "doc example fixture mock sample test".split()
SECRET_PATHS = "config credential env key secret".split()
PROVIDER_PREFIXES = "AKIA ASIA AIza ghp_ gho_ github_pat_ glpat- sk- sk_live_ xoxb- xoxp- eyJ".split()

FEATURES = (
    "length transitions digits capitals entropy pair_score coverage provider "
    "test_path secret_path in_path credential assigned quoted harmless key_block"
).split()

_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.S)
_VALUE = re.compile(r"[=:]\s{0,3}[\"']?([^\s\"',;<>=:#&*%|]{6,})")
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
_LETTER_RUN = re.compile(r"[^\W\d_]{3,}")
#: An assigned value, for Spark: it is left out where words are counted.
ASSIGNED = r"[=:]\s{0,3}[\"']?[^\s\"',;<>=:#&*%|]{6,}"
_CREDENTIAL = re.compile(r"(?i)(?:" + "|".join(CREDENTIAL_WORDS).replace("_", "[_-]?") + r")\W{0,6}\Z")
_HARMLESS = re.compile(r"(?i)\b(?:" + "|".join(HARMLESS_WORDS) + r")\b")
_PROVIDER = re.compile("|".join(map(re.escape, PROVIDER_PREFIXES)))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the candidates of a text, in order, without overlap."""
    spans = [m.span() for m in _BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    for m in _VALUE.finditer(text):
        # A value counts only behind a credential word; long runs come below.
        if _CREDENTIAL.search(text[max(0, m.start() - AROUND) : m.start()]):
            spans.append(m.span(1))
    spans += [m.span() for m in _RUN.finditer(text)]
    return _without_overlap(spans)


def _without_overlap(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that don't overlap an earlier one of the list."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in spans:
        i = bisect.bisect_left(starts, b)
        if i == 0 or ends[i - 1] <= a:
            at = bisect.bisect_left(starts, a)
            starts.insert(at, a)
            ends.insert(at, b)
    return list(zip(starts, ends, strict=True))


class Pairs:
    """How usual each pair of the letters a to z is: 676 numbers at most."""

    def __init__(self, counts: dict[str, int]):
        firsts: Counter = Counter()
        for pair, n in counts.items():
            firsts[pair[0]] += n
        self.score = {p: math.log((n + 0.5) / (firsts[p[0]] + 13)) for p, n in counts.items()}

    def mean(self, value: str) -> float:
        """Mean log probability of the letter after each letter."""
        low = value.lower()
        scores = [self.score.get(low[i : i + 2], -7.0) for i in range(len(low) - 1)]
        return sum(scores) / len(scores) if scores else 0.0


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(text: str, span: tuple[int, int], path: str, pairs: Pairs) -> list[float]:
    """The features of a candidate, in the order of ``FEATURES``; the dictionary coverage is joined later."""
    a, b = span
    value, before, after = text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]
    kinds = [_class(c) for c in value]
    n = len(value)
    near = before.rsplit(None, 1)[-1] if before.strip() and not before[-1:].isspace() else ""
    shares = [c / n for c in Counter(value).values()]
    low_path = path.lower()
    return [
        float(n),
        sum(x != y for x, y in zip(kinds, kinds[1:])) / max(1, n - 1),
        kinds.count(2) / n,
        kinds.count(1) / n,
        -sum(s * math.log2(s) for s in shares),
        pairs.mean(value),
        0.0,
        float(bool(_PROVIDER.match(value))),
        float(any(w in low_path for w in TEST_PATHS)),
        float(any(w in low_path for w in SECRET_PATHS)),
        float("/" in near or value.count("/") > 1),
        float(bool(_CREDENTIAL.search(before))),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(before[-1:] in "\"'" and bool(before) and after[:1] in "\"'" and bool(after)),
        float(bool(_HARMLESS.search(before)) or bool(_HARMLESS.search(after))),
        float(value.startswith("-----BEGIN")),
    ]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The dictionary ``(word, n)`` of all documents, a written table."""
    plain = F.regexp_replace(F.lower(F.col(text_col)), ASSIGNED, " ")
    word = F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")
    counts = docs.select(word).where(F.length("word").between(*WORD_LETTERS)).groupBy("word").agg(F.count("*").alias("n"))
    return written(counts.where(F.col("n") >= WORD_COUNT), "word-counts")


def letter_pairs(words: DataFrame) -> Pairs:
    """The letter pairs of the dictionary's words."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("pair")
    return Pairs(dict(words.select(pair, "n").where(F.col("pair").rlike("^[a-z]{2}$")).groupBy("pair").agg(F.sum("n")).collect()))


def row_key(text: Column, path: Column) -> Column:
    """Equal for rows with equal texts and paths."""
    return F.md5(F.encode(F.concat(F.coalesce(path, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))), "utf-8"))


FOUND = "doc_id long, row_key string, start int, length int, value_sha256 string, features array<double>, runs array<string>"


def scan(docs: DataFrame, pairs: Pairs, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Candidates with features: ``(doc_id, row_key, start, length, value_sha256, features, runs)``.
    Starts and lengths are in characters; of the value itself, its digest and its
    lower-cased runs of letters leave the task."""
    path = F.col(path_col).cast("string") if path_col else F.lit("")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, text, where in zip(*(batch.column(c) for c in ("doc_id", "row_key", "text", "path")), strict=True):
                text = text.as_py() or ""
                for a, b in candidates(text):
                    digest = hashlib.sha256(text[a:b].encode()).hexdigest()
                    out.append((doc_id.as_py(), key.as_py(), a, b - a, digest, describe(text, (a, b), where.as_py() or "", pairs), _LETTER_RUN.findall(text[a:b].lower())))
            if out:
                types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "row_key", "start", "length", "value_sha256", "features", "runs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col), path).alias("row_key"), F.col(text_col).alias("text"), path.alias("path"))
    return rows.mapInArrow(run, FOUND)


def feature(name: str) -> Column:
    return F.col("features")[FEATURES.index(name)]


def _run_key() -> Column:
    return F.md5(F.encode("run", "utf-8"))


def _covered_keys(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``(run_key, covered)`` of distinct runs. A run is cut into pieces of ``PIECE``
    starts, each with the letters that a word from its last start can reach, so
    that no row holds a long run and the work grows with the letters."""
    least, most = WORD_LETTERS
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("run") - least) / PIECE).cast("int")), lambda p: F.struct((p * PIECE).alias("base"), F.substring("run", p * PIECE + 1, F.lit(PIECE + most - 1)).alias("piece")))
    pieces = runs.where(F.length("run") >= least).select(_run_key().alias("run_key"), F.inline(cut))
    starts = pieces.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("piece") - (least - 1)))).alias("start"))
    sizes = F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.length("piece") - F.col("start") + 1))).alias("size")
    parts = starts.select("*", sizes).select("run_key", (F.col("base") + F.col("start")).alias("at"), "size", F.expr("substring(piece, start, size)").alias("word"))
    known = parts.join(words.select("word"), "word").groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("size")).alias("to")))).alias("parts"))
    grow = lambda done, p: F.struct(
        (done["n"] + F.greatest(F.lit(0), p["to"] - F.greatest(p["at"], done["reach"]))).alias("n"), F.greatest(done["reach"], p["to"]).alias("reach")
    )
    return known.select("run_key", F.aggregate("parts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), grow)["n"].alias("covered"))


def covered_runs(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``(run, covered)``: how many letters of each run lie inside words of the dictionary.

    Every part of a run that could be a word is joined with the dictionary;
    the parts that are words may overlap, and their union counts.
    """
    own = runs.select("run").distinct()
    return own.withColumn("run_key", _run_key()).join(_covered_keys(own, words), "run_key").select("run", "covered")


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the dictionary coverage among its features, and without its runs."""
    values = found.groupBy("value_sha256").agg(F.first("runs").alias("runs"), F.first("length").alias("length"))
    runs = values.select("value_sha256", "length", F.explode("runs").alias("run"))
    keyed = runs.select("value_sha256", "length", _run_key().alias("run_key"))
    share = keyed.join(_covered_keys(runs.select("run").distinct(), words), "run_key").groupBy("value_sha256").agg((F.sum("covered") / F.first("length")).alias("coverage"))
    at = FEATURES.index("coverage")
    filled = F.transform("features", lambda x, i: F.when(i == at, F.coalesce("coverage", F.lit(0.0))).otherwise(x))
    return found.join(share, "value_sha256", "left").select("doc_id", "row_key", "start", "length", "value_sha256", filled.alias("features"))


def findings(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """All candidates of ``docs`` with all features, a written table; with a ``label`` it can be given to ``fit``."""
    with arrow_rows(docs.sparkSession, BATCH):
        found = written(scan(docs, letter_pairs(words), id_col, text_col, path_col), "secret-candidates")
    return written(covered(found, words), "secret-findings", keep=True)


def _inputs() -> Column:
    return array_to_vector(F.array(*[feature(f) for f in FEATURES]))


#: Paths of planted texts.
PLAIN_PATHS = ["", "src3", "notes/today.txt", "blog/post.html", "lib/core.py", "README.md"]
OPEN_PATHS = ["tests/test_login.py", "docs/usage.md", "examples/run.sh", "spec/fixtures/a.json", "mock/server.js", "sample/app.ini"]
CLOSED_PATHS = ["config/prod.yml", "deploy/.env", "etc/credentials.ini", "ops/secrets.tf", "ssh/keys.txt"]


def planted(spark: SparkSession, words: DataFrame, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """Texts with one finding of a known kind each: ``(doc_id, text, source, at, label)``.

    At most ``PLANTED_WORDS`` frequent words of the dictionary are read for
    them. Half of the findings are secrets (label 1), of six kinds: random
    values behind a credential word, the same of letters only, provider keys,
    key blocks, random values in configuration files. The rest are none, of eight kinds:
    placeholders made of words, digests behind a word that says so, secrets in
    files of tests and samples or next to words such as ``example``, names and
    long words, numbers, paths, random values that nothing speaks for.
    """
    r = random.Random(seed)
    pool = [w.word for w in words.orderBy(F.desc("n"), "word").limit(PLANTED_WORDS).select("word").collect()] or ["value", "water", "house"]
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    letters = lambda n: "".join(r.choices(string.ascii_lowercase, k=n))
    token = lambda: r.choice([hexes(r.choice([18, 24, 32, 40])), mixed(r.randint(12, 48))])
    long_token = lambda: r.choice([hexes(r.choice([32, 40, 64])), mixed(r.randint(24, 48))])
    compound = lambda join, n: join.join(r.choices(pool, k=n))

    def assigned(name: str, value: str) -> tuple[str, str, str]:
        sign = r.choice([" = ", "=", ": ", ":"])
        mark = r.choice(['"', "'", "", ""])
        return f"{name}{sign}{mark}", value, mark

    def at_least(value, least: int = 16) -> str:
        out = value()
        while len(out) < least:
            out += value()
        return out

    credential = lambda: r.choice(CREDENTIAL_WORDS)
    plain_or_closed, any_path = PLAIN_PATHS * 2 + CLOSED_PATHS, PLAIN_PATHS + OPEN_PATHS + CLOSED_PATHS
    secrets = [
        lambda: (*assigned(credential(), token()), plain_or_closed),
        lambda: (*assigned(credential(), letters(r.randint(10, 24))), plain_or_closed),
        lambda: ("", r.choice(PROVIDER_PREFIXES) + r.choice([mixed(r.randint(16, 40)), "".join(r.choices(string.ascii_uppercase + "234567", k=16))]), "", plain_or_closed),
        lambda: (*assigned(credential(), r.choice(PROVIDER_PREFIXES) + mixed(r.randint(16, 40))), plain_or_closed),
        lambda: ("", f"-----BEGIN RSA PRIVATE KEY-----\n{mixed(r.randint(200, 1600))}\n-----END RSA PRIVATE KEY-----", "", any_path),
        lambda: (*assigned(r.choice(pool), long_token()), CLOSED_PATHS),
    ]
    others = [
        lambda: (*assigned(credential(), compound(r.choice("_-/"), r.randint(2, 4))), any_path),
        lambda: (r.choice([f"{w} " for w in HARMLESS_WORDS] + [f"{credential()} {w}: " for w in HARMLESS_WORDS]), long_token(), "", PLAIN_PATHS + OPEN_PATHS),
        lambda: (*assigned(credential(), token()), OPEN_PATHS),
        lambda: (*assigned(f"{r.choice(['example', 'dummy', 'sample', 'placeholder'])} {credential()}", token()), PLAIN_PATHS + OPEN_PATHS),
        lambda: ("", at_least(lambda: r.choice([compound("", 3), compound("_", 3), "".join(w.capitalize() for w in r.choices(pool, k=3))])), "", any_path),
        lambda: ("", "".join(r.choices(string.digits, k=r.choice([16, 16, 18, 20]))), "", any_path),
        lambda: ("", at_least(lambda: "/" + compound("/", r.randint(2, 4))), "/", any_path),
        lambda: (*r.choice([assigned(r.choice(pool), long_token()), ("", long_token(), "")]), PLAIN_PATHS + OPEN_PATHS),
    ]
    out = []
    for i in range(rows):
        label = i % 2
        before, value, after, paths = r.choice(secrets if label else others)()
        lead = " ".join([*r.choices(pool, k=r.randint(3, 20)), before])
        out.append((i, f"{lead}{value}{after} {' '.join(r.choices(pool, k=r.randint(3, 20)))}", r.choice(paths), len(lead), float(label)))
    return spark.createDataFrame(out, "doc_id long, text string, source string, at int, label double")


def planted_findings(spark: SparkSession, words: DataFrame, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """The candidates in ``planted`` texts that begin where a finding was planted, with its label."""
    texts = written(planted(spark, words, rows, seed), "secret-planted")
    labels = texts.select("doc_id", F.col("at").alias("start"), "label")
    return findings(texts, words).join(labels, ["doc_id", "start"])


def fit(labelled: DataFrame) -> RandomForestClassificationModel | float:
    """A forest from findings with a ``label``; the only label, if there is one kind (1 without any)."""
    known = labelled.where("label is not null")
    # Copies have equal texts and paths, and so equal features.
    distinct = written(known.groupBy("row_key", "start", "value_sha256", "label").agg(F.first("features").alias("features"), F.count("*").alias("copies")), "secret-distinct")
    kinds = {r.label: r["count"] for r in distinct.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return next(iter(kinds), 1.0)
    # Half of the rows for each label, as far as there are so many, by a hash of the value. First about
    # a quarter too many are taken by share, so that ordering moves few rows and always has enough.
    half = TRAINING_ROWS // 2
    hashed = F.xxhash64("value_sha256", "start", "row_key")
    limit = F.lit(None).cast("double")
    for label, n in kinds.items():
        limit = F.when(F.col("label") == label, min(1.0, 1.25 * half / n)).otherwise(limit)
    near = distinct.where(hashed / 2.0**64 + 0.5 <= limit).withColumn("ticket", hashed)
    drawn = [near.where(F.col("label") == label).orderBy("ticket", "value_sha256", "start", "row_key").limit(half) for label in sorted(kinds)]
    rows = written(reduce(DataFrame.union, drawn).select("features", "label", (1 + F.log("copies")).alias("weight")), "secret-training")
    sums = {r.label: r["sum(weight)"] for r in rows.groupBy("label").sum("weight").collect()}
    if len(sums) < 2:
        return next(iter(sums), 1.0)
    # Both labels weigh the same, however rare secrets are.
    total = F.when(F.col("label") == 1, sums[1.0]).otherwise(sums[0.0])
    rows = rows.select(_inputs().alias("x"), "label", (F.col("weight") / total * TRAINING_ROWS).alias("weight"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    return forest.fit(rows)


def judge(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """``found`` with ``probability`` and ``is_secret`` in place of the features."""
    if isinstance(model, float):
        scored = found.withColumn("probability", F.lit(model))
    else:
        named = model.setFeaturesCol("x").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p")
        scored = named.transform(found.withColumn("x", _inputs())).withColumn("probability", vector_to_array("p")[1]).drop("x", "p")
    return scored.withColumn("is_secret", F.col("probability") >= CUTOFF).drop("features")


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every candidate of every whole text with its verdict:
    ``(doc_id, row_key, start, length, value_sha256, probability, is_secret)``.

    ``labelled``: a table as ``findings`` returns, with a ``label`` (1 secret,
    0 none, null not known); without it, ``planted_findings`` train the forest.
    """
    spark = docs.sparkSession
    with scratch(spark):
        words = count_words(docs, text_col)
        found = findings(docs, words, id_col, text_col, path_col)
        with scratch(spark):
            model = fit(planted_findings(spark, words) if labelled is None else labelled)
    return judge(found, model)


def redact(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``MASK``. All rows
    and columns stay; ``length_col`` is the new length of a changed text."""
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    with scratch(docs.sparkSession):
        found = find_secrets(docs, labelled, id_col, text_col, path_col).where("is_secret")
        spans = found.groupBy(F.col("row_key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_spans"))
        spans = written(spans, "secret-spans", keep=True)
    # Kept stretches: from the end of each span to the start of the next.
    text, s = F.col(text_col), F.col("_spans")
    n = F.size(s)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["start"] + F.get(s, i - 1)["length"])
    end = lambda i: F.when(i == n, F.length(text)).otherwise(F.get(s, i)["start"])
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, end(i) - begin(i)))
    clean = F.when(s.isNotNull(), F.array_join(parts, MASK)).otherwise(text)
    joined = docs.join(spans, row_key(text, path) == F.col("_key"), "left").withColumn("_clean", clean)
    out = [F.col(c) for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c == text_col:
            out[i] = F.col("_clean").alias(c)
        elif c == length_col:
            out[i] = F.when(s.isNotNull(), F.length("_clean")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
    return joined.select(*out)
