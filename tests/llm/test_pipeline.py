"""The pipeline's stages, and the registered queries with their SQL."""

import base64
import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import language_id, queries, secret_scan
from tidewire.llm.common import shared_dir
from tidewire.llm.common import table as common_table

from ..oracle import assert_same, connect
from .test_decontaminate import brute as leaks
from .test_minhash import brute as groups


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-dedup", "decontamination", "secret scan", "byte-level BPE"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).persist()
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()}
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        if name == "language ID":
            assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "near-dedup":
            assert set(after) == {i for i, (_, c) in groups(list(before.items()), 80).items() if i == c}
        elif name == "decontamination":
            assert set(after) == set(before) - {i for i, _ in leaks(list(before.items()), items)}
        elif name == "secret scan":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i])
            assert not out.where(F.col("text").rlike(r"token = \"[0-9a-f]{40}|password=[0-9a-f]{18}|AKIA[A-Z0-9]{16}")).count()
        else:
            assert set(after) == set(before)
        docs = out


def nearest(training, docs):
    """Which documents the first stage keeps, by its definitions, one text at a time."""
    idf, centroids = np.log((1 + len(training)) / (1 + sum((language_id.counts(t) > 0).astype(int) for _, t in training))) + 1, {}

    def unit(text):
        v = np.log1p(language_id.counts(text)) * idf
        return v / np.linalg.norm(v) if v.any() else v

    for lang in sorted({x for x, _ in training}):
        x = np.array([unit(t) for g, t in training if g == lang and any(c.isalpha() for c in t)], np.float32)
        centres = language_id.cluster(x, language_id.CENTROIDS)
        centroids[lang] = centres, language_id.MARGIN * np.quantile((x @ centres.T).max(axis=1), 1 - language_id.KEPT)
    kept = set()
    for i, text in docs:
        if text and any(c.isalpha() for c in text):
            cosine, least = max(((centres @ unit(text)).max(), least) for centres, least in centroids.values())
            if cosine >= least * min(language_id.counts(text).sum() / language_id.FULL_SIZE, 1):
                kept.add(i)
    return kept


def test_run_against_brute_force(spark, small):
    """run() from end to end: what each stage keeps, what it changes, and the last digests."""
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    training = [(lang, t) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None]
    assert max(Counter(g for g, _ in training).values()) <= language_id.SAMPLE  # all are in the sample
    docs = [(i, t) for i, t, _ in rows]
    kept = nearest(training, docs)
    docs = [d for d in docs if d[0] in kept]
    group = groups(docs, 80)
    docs = [d for d in docs if d[0] == group[d[0]][1]]
    found_leaks = {i for i, _ in leaks(docs, items)}
    docs = [d for d in docs if d[0] not in found_leaks]
    masked = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame([(i, t, "", 0) for i, t in docs], "doc_id long, text string, source string, n_chars long")).collect()}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: library.encode_ordinary(t) for i, t in masked.items()}
    want = {(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(masked[i].encode()).hexdigest()) for i, x in ids.items()}
    before = tables(spark)
    found = corpus_pipeline.run(spark, small).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 50
    assert len(tables(spark) - before) <= 2  # the last stage's input is left, all other tables are gone


def tables(spark):
    folder = shared_dir(spark).removeprefix("file://")
    return {p.name for p in Path(folder).iterdir()} if Path(folder).exists() else set()


def test_run_on_odd_and_empty_documents(spark, odd, odd_rows, empty, small, monkeypatch):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, empty):
        monkeypatch.setattr(corpus_pipeline, "table", lambda spark, d, name, docs=docs: docs.select(*columns) if name == "documents" else common_table(spark, d, name))
        found = corpus_pipeline.run(spark, small)
        assert found.columns[:2] == ["doc_id", "n_tokens"] and found.count() <= docs.count()
        assert (found.count() > 0) == (docs is odd)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    if name in queries.oracle_sql():
        assert_same(df, connect(small), queries.oracle_sql()[name])
    else:
        assert df.count() > 0
