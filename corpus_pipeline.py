"""A corpus pipeline of five stages over ``documents``.

Language ID drops documents that it rejects, near-dedup keeps one document
of each group, decontamination drops documents that hold benchmark items,
the secret scan masks secrets, and byte-level BPE encodes what is left.
Each stage works on all that its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import bpe, decontaminate, language_id, minhash, secret_scan
from tidewire.llm.common import remove, scratch, table, written_at
from tidewire.llm.queries import held_out

#: No SQL can express the first stage's model; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs.where(~held_out())))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("secret scan", mask_secrets),
    ("byte-level BPE", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again for the next.

    A stage's input and its own tables are removed once its output is written;
    the input of the last stage stays, as its rows are made when they are read.
    Every stage's operator says what it makes of nulls, empty, long and
    repeated texts; without documents there are no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = written_at(out, "pipeline-" + name.replace(" ", "-"), keep=True)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
