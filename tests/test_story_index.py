"""What the index of stories writes and shuffles, and its rows on odd tables."""

import contextlib

import pytest
from pyspark.sql import functions as F

from tidewire.operators import semantics
from tidewire.plans import oracle, queries
from tidewire.sources import stories, workspace

from .oracle import TABLES, assert_same, connect


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {f"spark.sql.{k.replace('_', '.')}": v for k, v in conf.items()}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_texts_are_written_once(spark, small, monkeypatch):
    """Of all tables that are written only the index has texts: they are neither numbered nor kept on the way."""
    seen, whole = [], workspace.written_at
    monkeypatch.setattr(workspace, "written_at", lambda df, name, *a, **k: seen.append((name, df.columns)) or whole(df, name, *a, **k))
    assert queries.queries()["x6_index"](spark, small).count() > 0
    assert [name for name, columns in seen if {"title", "document", "text"} & {*columns}] == ["index"]


def test_texts_are_dealt_once(spark, small):
    """Keywords and the index share one shuffle of whole texts, where nothing is small enough for a broadcast."""

    def shuffles(node):
        below = [x for i in range(node.children().size()) for x in shuffles(node.children().apply(i))]
        return [node, *below] if node.nodeName() == "Exchange" else below

    with settings(spark, adaptive_enabled="false", autoBroadcastJoinThreshold="-1"):
        rows = stories.whole_stories(spark, small).join(queries.placed_stories(spark, small), "id")
        dealt = [x for x in shuffles(rows._jdf.queryExecution().executedPlan()) if "title" in x.output().toString() and "hash" in x.outputPartitioning().toString()]
        assert len(dealt) == 1
        assert rows.count() == stories.whole_stories(spark, small).count()


def test_no_word_is_shuffled(spark, small):
    """Scores are summed where a text lies: a shuffle has a row for each text, not for each word, and nothing is joined."""
    plan = queries.lexicon_scores(spark, small)._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString()
    assert not [line for line in plan.executedPlan().toString().splitlines() if "Exchange hash" in line and "token" in line]


def test_sums_of_a_round_go_by_texts(spark, monkeypatch):
    """Tasks, each with sums as large as the model, don't grow in number with the files of features."""
    seen, whole = [], semantics._sketched
    monkeypatch.setattr(semantics, "_sketched", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or whole(rows, *a))
    texts = spark.range(400).repartition(40).select(F.concat_ws(" ", F.lit("w"), F.col("id"), F.col("id") % 7).alias("document"))
    with settings(spark, files_openCostInBytes="1048576", files_maxPartitionBytes="1048576"):
        few = semantics.fit(texts, dims=3, features=64)
        monkeypatch.setattr(semantics, "TEXTS", 40)
        semantics.fit(texts, dims=3, features=64)
    assert few.vectors.any() and max(seen[:2]) <= 4 and set(seen[2:]) == {10}


@pytest.fixture
def odd_dir(spark, small, tmp_path):
    """Vectors twice, without a label or without a document; documents without text, id or event."""
    for t in TABLES:
        df = spark.read.parquet(f"{small}/{t}.parquet")
        if t == "embeddings":
            df = df.where("vec_id % 5 <> 0").withColumn("label", F.when(F.col("vec_id") % 4 != 0, F.col("label"))).union(df.where("vec_id % 6 = 1"))
        if t == "documents":
            df = df.withColumn("text", F.when(F.col("doc_id") % 8 != 0, F.col("text"))).withColumn("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")))
        if t == "events":
            df = df.where("event_id % 3 <> 0")
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["x6_index", "x1_sentiment"])
def test_odd_tables(spark, odd_dir, name):
    con = connect(odd_dir)
    for t in TABLES:  # folders
        con.execute(f"create or replace view {t} as select * from read_parquet('{odd_dir}/{t}.parquet/*.parquet')")
    assert_same(queries.queries()[name](spark, odd_dir), con, oracle.oracle_sql()[name])
