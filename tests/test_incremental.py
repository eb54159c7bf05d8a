"""Commits by several writers, and an index that embeds only what differs."""

import threading

from pyspark.sql import functions as F

from tidewire.operators import incremental, semantics
from tidewire.sources.commits import Versions


def test_one_version_for_one_writer(spark, tmp_path):
    versions = Versions(spark, f"{tmp_path}/v")
    assert versions.latest() == (0, {})
    assert versions.commit(1, {"by": "a"}) and not versions.commit(1, {"by": "b"})
    assert versions.latest() == (1, {"by": "a"})
    assert sorted(p.name for p in (tmp_path / "v").iterdir() if not p.name.startswith(".")) == ["v1.json"]


def test_writers_at_once(spark, tmp_path):
    got = []

    def write(name):
        own = Versions(spark, f"{tmp_path}/v")
        got.append(own.update(lambda n, last: {"names": [*last.get("names", []), name]}))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4]
    assert sorted(Versions(spark, f"{tmp_path}/v").latest()[1]["names"]) == [0, 1, 2, 3]


class Counted:
    """An embedding that notes which ids it was given."""

    def __init__(self):
        self.seen = []

    def __call__(self, df):
        self.seen.append(sorted(r.id for r in df.select("id").collect()))
        return df.withColumn("embedding", F.array(F.length(F.coalesce("document", F.lit(""))).cast("float")))


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, document string")


def state(index):
    return {r.id: (r.document, r.version, r.embedding[0]) for r in index.read().collect()}


def test_only_differences_are_embedded(spark, tmp_path):
    count = Counted()
    index = incremental.Index(spark, f"{tmp_path}/i", count)
    assert index.read() is None
    assert index.update(frame(spark, [(1, "a"), (2, "bb"), (3, None), (None, "x"), (2, "bb")])) == 1
    assert index.update(frame(spark, [(3, None), (2, "bb"), (1, "a")])) == 1  # the same texts
    assert index.update(frame(spark, [(1, "a"), (2, "other"), (4, "new")])) == 2
    assert count.seen == [[1, 2, 3], [2, 4]]
    assert state(index) == {1: ("a", 1, 1.0), 2: ("other", 2, 5.0), 4: ("new", 2, 3.0)}
    assert index.update(frame(spark, [(3, "back"), (1, "a")])) == 3
    assert state(index) == {1: ("a", 1, 1.0), 3: ("back", 3, 4.0)}
    assert index.update(frame(spark, [])) == 4 and state(index) == {}


def test_many_segments_are_merged_and_old_ones_expire(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SEGMENTS", 3)
    index = incremental.Index(spark, f"{tmp_path}/i", Counted())
    for i in range(6):
        index.update(frame(spark, [(j, "x" * (1 + (i == j))) for j in range(6)]))
    want = state(index)
    assert len(index.versions.latest()[1]["segments"]) <= 3 and len(want) == 6
    index.expire(keep=1)
    assert state(index) == want


def test_with_learned_embeddings(spark, tmp_path):
    docs = frame(spark, [(i, f"word{i % 5} common text {i}") for i in range(40)])
    model = semantics.fit(docs, dims=4, features=256)
    index = incremental.Index(spark, f"{tmp_path}/i", model.embed)
    index.update(docs)
    index.update(docs.withColumn("document", F.when(F.col("id") == 7, "word1 anew").otherwise(F.col("document"))))
    want = {r.id: r.embedding for r in model.embed(frame(spark, [(i, "word1 anew" if i == 7 else f"word{i % 5} common text {i}") for i in range(40)])).collect()}
    assert {r.id: r.embedding for r in index.read().collect()} == want
