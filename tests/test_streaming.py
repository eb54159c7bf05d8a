"""Streams that take what has landed and end, against batches."""

import datetime
import json

import pytest

from tidewire.streaming import refresh


def test_refresh_publishes_and_replaces(spark, tmp_path):
    landed, out = tmp_path / "in", f"{tmp_path}/out"
    landed.mkdir()
    publish = lambda df, n: df.write.mode("overwrite").parquet(out)

    def cycle():
        stream = refresh.item_stream(spark, str(landed))
        refresh.refresh(stream, lambda df: df.select("id"), publish, f"{tmp_path}/state", once=True).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    (landed / "a.json").write_text(json.dumps({"id": 1, "title": "x"}))
    assert cycle() == [1]
    (landed / "b.json").write_text(json.dumps({"id": 2, "title": "y"}))
    assert cycle() == [2]


def test_retries():
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

    refresh.retried(work, wait=0)
    assert len(tries) == 3
    with pytest.raises(ZeroDivisionError):
        refresh.retried(lambda: 1 / 0, wait=0)


def test_dedup_within_watermark(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t), (1, t), (2, t)], "id long, time timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, time timestamp").parquet(f"{tmp_path}/in")
    kept = refresh.run_once(refresh.deduplicated(stream, "id", "time"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.id for r in kept.collect()) == [1, 2]
