"""Language ID: nearest centroid over TF-IDF n-gram vectors.

A text's vector counts its character n-grams (1 to 3 letters, lower case,
words delimited) in ``DIMS`` hashed buckets; counts are damped, weighted by
inverse document frequency and normalised. Each language has several
centroids, found by spherical k-means, since one language can have several
kinds of text. A text takes the language of its nearest centroid by cosine.
It is rejected if it is further from that centroid than nearly all texts
that the model was fitted on, by a margin; short texts have a lower limit.

Document frequencies come from all training texts. Centroids are fitted on
a bounded sample of them: ``SAMPLE`` texts a language, by a hash of the id;
a language's sample is fitted in a task of its own.

Defined cases: a null text, or one without letters, is ``und`` with score 0
and is rejected. A language of fewer texts than centroids gets as many
centroids as it has texts. Training rows with null text or language are
left out; without any, the model is empty and all texts are ``und``. Ties
between centroids go to the smaller language name. Only the named columns
are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, trimmed

UNDETERMINED = "und"
DIMS = 1 << 12
#: Centroids per language.
CENTROIDS = 4
#: Texts per language that the centroids are fitted on.
SAMPLE = 300
#: A text is rejected under this share of the least cosine that ``KEPT`` of the sample reach.
MARGIN, KEPT = 0.5, 0.99
#: Texts of fewer n-grams (three a letter) have less to be near by: their limit is in proportion.
FULL_SIZE = 300
#: Texts are cut into stretches of so many characters for the counting.
STRETCH = 1 << 18
#: Texts in a batch between Spark and Python.
BATCH = 1000

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}]+")


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in a whole text."""
    total = np.zeros(DIMS, np.float64)
    if not text:
        return total
    letters = _OTHER.sub(" ", text.lower())
    for start in range(0, len(letters), STRETCH):
        # Two characters are repeated so that n-grams across the cut count once.
        part = letters[start - 2 : start + STRETCH] if start else f"  {letters[:STRETCH]}"
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        one, two, three = c[2:], c[1:-1], c[:-2]
        inside = one != 32
        h1 = one[inside] * np.uint32(2654435761)
        h2 = (one * np.uint32(2246822519)) ^ ((two + np.uint32(7)) * np.uint32(3266489917))
        h3 = (h2 * np.uint32(668265263)) ^ ((three + np.uint32(11)) * np.uint32(374761393))
        h = np.concatenate([h1, h2, h3])
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        total += np.bincount(h >> np.uint32(33 - DIMS.bit_length()), minlength=DIMS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A unit vector for each text, and how many n-grams the text has."""
    out, sizes = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts))
    for i, text in enumerate(texts):
        found = counts(text)
        out[i], sizes[i] = np.log1p(found) * idf, found.sum()
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1), sizes


def cluster(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean, then the farthest ones."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    centres = x[start]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


@dataclass(frozen=True)
class Model:
    """Weights, centroids with their languages, and each centroid's least cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and whether it is rejected, of each text."""
        known = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        names, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if known:
            x, sizes = vectors([texts[i] for i in known], self.idf)
            cosine = x @ self.centroids.T
            best = cosine.argmax(axis=1)
            score[known] = np.clip(cosine[np.arange(len(known)), best], 0, 1)
            rejected[known] = score[known] < self.least[best] * np.minimum(sizes / FULL_SIZE, 1)
            for i, b in zip(known, best, strict=True):
                names[i] = self.languages[b]
        return names, score, rejected


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in ``training``.

    The driver receives the document frequency of each bucket and the
    centroids: ``DIMS`` numbers, and ``DIMS`` for each centroid.
    """
    rows = training.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")

    @trimmed
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                total += counts(text.as_py()) > 0
                n += 1
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, total[at]])], ["bucket", "n"])

    with arrow_rows(training.sparkSession, BATCH):
        found = dict(rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect())
    n = found.pop(-1, 0)
    frequency = np.zeros(DIMS)
    for bucket, count in found.items():
        frequency[bucket] = count
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)

    # A ticket thins each language to about twice its sample first, so that no
    # language is sorted in one task.
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == lang, min(1.0, 2 * SAMPLE / n)) for lang, n in totals.items()], F.lit(0.0))
    ticket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / (1 << 40)
    by_hash = Window.partitionBy("lang").orderBy(ticket, "doc_id")
    thinned = rows.select("doc_id", "lang").where(ticket < share)
    chosen = thinned.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= SAMPLE).select("doc_id", F.col("lang").alias("chosen_lang"))
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        x = vectors([t for t in group["text"] if has_letter(t)], idf)[0]
        x = x[(x != 0).any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        centres = cluster(x, CENTROIDS)
        cosine = x @ centres.T
        least = MARGIN * float(np.quantile(cosine.max(axis=1), 1 - KEPT))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.astype("<f4").tobytes() for c in centres], "least": least})

    fitted = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, least double").collect(), key=lambda r: (r[0], bytes(r[1])))
    matrix = np.array([np.frombuffer(r[1], "<f4") for r in fitted], np.float32).reshape(len(fitted), DIMS)
    return Model(idf, matrix, [r[0] for r in fitted], np.array([r[2] for r in fitted]))


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every whole text. The
    model, some 20 KB for each centroid, goes to the executors with the task."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, score, rejected = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected, all columns as they are.

    Rows are judged where they stand, by position, so ids need not be unique.
    """
    schema = docs.schema

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _, _, rejected = model.predict(part.column(text_col).to_pylist())
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, schema)
