"""History of stories: insert-or-ignore, reports over time, briefing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import HISTORY
from .metrics import kpis

COLUMNS = [c.split()[0] for c in HISTORY.split(", ")]


def as_history(stories: DataFrame) -> DataFrame:
    return stories.select("id", "title", "score", "sentiment_score", "topic_keyword", F.col("time").cast("timestamp").alias("timestamp"))


def not_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` with an id that isn't stored; of equal new ids, the first by time."""
    # Ids first, so that what is stored already isn't grouped, and rows that lie by id stay where they are.
    fresh = new.join(stored.select("id").distinct(), "id", "left_anti")
    return fresh.groupBy("id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "id"]), F.struct("timestamp", "title", "score")).alias("r")).select("id", "r.*")


def insert_or_ignore(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The history with the new rows in it."""
    return stored.select(*COLUMNS).union(not_stored(new, stored).select(*COLUMNS))


def append(new: DataFrame, path: str) -> None:
    """Append to a history table partitioned by date; ids that are there are ignored."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    stored = spark.read.parquet(path) if exists else spark.createDataFrame([], HISTORY)
    not_stored(new, stored).withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(path)


def latest(history: DataFrame, limit: int = 1000) -> DataFrame:
    return history.orderBy(F.desc("timestamp"), "id").limit(limit)


def all_time_top(history: DataFrame, limit: int = 50) -> DataFrame:
    return history.orderBy(F.desc("score"), "id").limit(limit)


def briefing(stories: DataFrame, limit: int = 5) -> DataFrame:
    """The best stories, each with the day's numbers: date, mean sentiment, top topic."""
    top = stories.orderBy(F.desc("score"), "id").limit(limit)
    day = stories.agg(F.max(F.to_date("time")).alias("date"))
    numbers = kpis(stories).select("average_sentiment", "top_topic")
    # One row on either side.
    head = day.join(numbers, F.lit(True))
    return top.select("id", "title", "url", "score").join(F.broadcast(head), F.lit(True))


def page(stories: DataFrame, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """A page of stories by score; ``after`` is the (score, id) that the last page ended with."""
    rest = stories if after is None else stories.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("id") > after[1])))
    return rest.orderBy(F.desc("score"), "id").limit(size)
