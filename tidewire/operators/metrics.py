"""Dashboard numbers: KPIs, distributions, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import sentiment_label
from ..schemas import NO_TOPIC, OUTLIER_ID, OUTLIER_TOPIC, TOO_FEW

NO_TOPICS = "No topics"


def is_topic(strict_labels: bool = False) -> Column:
    """Whether a story has a topic. ``strict_labels`` leaves out the outliers'
    label only, so other labels that are no topic count."""
    return F.col("topic_keyword") != OUTLIER_TOPIC if strict_labels else F.col("topic_id") != OUTLIER_ID


def share(count: Column) -> Column:
    """Percent of a count in the sum of all rows; for tables of categories."""
    return F.round(100.0 * count / F.sum(count).over(Window.partitionBy(F.lit(1))), 6)


def top_topic(stories: DataFrame, strict_labels: bool = False) -> DataFrame:
    """The most frequent topic keyword, the smallest of several: one row ``(top_topic)``."""
    counts = stories.where(is_topic(strict_labels)).groupBy("topic_keyword").agg(F.count("*").alias("n"))
    best = counts.agg(F.max_by("topic_keyword", F.struct("n")).alias("any"), F.min(F.struct((-F.col("n")).alias("n"), "topic_keyword")).alias("first"))
    return best.select(F.coalesce("first.topic_keyword", F.lit(NO_TOPICS)).alias("top_topic"))


def kpis(stories: DataFrame, strict_labels: bool = False) -> DataFrame:
    """One row: stories, mean sentiment and its mood, comments, top topic.

    Partial sums by topic feed all numbers, so the stories are read once.
    """
    named = stories.withColumn("_topic", F.when(is_topic(strict_labels), F.col("topic_keyword")))
    parts = named.groupBy("_topic").agg(F.count("*").alias("n"), F.count("sentiment_score").alias("scored"), F.sum("sentiment_score").alias("sentiment"), F.sum("descendants").alias("comments"))
    row = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("stories"),
        F.round(F.sum("sentiment") / F.sum("scored"), 6).alias("average_sentiment"),
        F.coalesce(F.sum("comments"), F.lit(0)).alias("total_comments"),
        F.min(F.when(F.col("_topic").isNotNull(), F.struct((-F.col("n")).alias("n"), "_topic"))).alias("first"),
    )
    mood = F.when(F.col("average_sentiment").isNotNull(), sentiment_label(F.col("average_sentiment")))
    return row.select("stories", "average_sentiment", mood.alias("mood"), "total_comments", F.coalesce("first._topic", F.lit(NO_TOPICS)).alias("top_topic"))


def mean_sentiment(stories: DataFrame) -> DataFrame:
    return stories.agg(F.round(F.avg("sentiment_score"), 6).alias("average_sentiment"))


def total_comments(stories: DataFrame) -> DataFrame:
    return stories.agg(F.coalesce(F.sum("descendants"), F.lit(0)).alias("total_comments"))


def sentiment_distribution(stories: DataFrame) -> DataFrame:
    """``(sentiment_label, n, percent)``."""
    return stories.groupBy("sentiment_label").agg(F.count("*").alias("n")).withColumn("percent", share(F.col("n")))


def topic_distribution(stories: DataFrame, limit: int = 5) -> DataFrame:
    """The largest topics ``(topic_id, topic_keyword, n, percent)`` of all stories, and the outliers."""
    counts = stories.groupBy("topic_id").agg(F.count("*").alias("n"), F.min("topic_keyword").alias("topic_keyword")).withColumn("percent", share(F.col("n")))
    top = counts.where(F.col("topic_id") != OUTLIER_ID).orderBy(F.desc("n"), "topic_id").limit(limit)
    return top.unionByName(counts.where(F.col("topic_id") == OUTLIER_ID)).select("topic_id", "topic_keyword", "n", "percent")


def topic_count(stories: DataFrame) -> DataFrame:
    return stories.agg(F.count_distinct(F.when(F.col("topic_id") != OUTLIER_ID, F.col("topic_id"))).alias("topics"))


def trending(stories: DataFrame, limit: int = 7) -> DataFrame:
    """The keywords of most stories, outliers excluded."""
    counts = stories.where(is_topic()).groupBy("topic_keyword").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "topic_keyword").limit(limit)


def topic_info(stories: DataFrame) -> DataFrame:
    """``(topic_id, n, name)``, the name being ``{id}_{keyword}``."""
    found = stories.groupBy("topic_id").agg(F.count("*").alias("n"), F.min("topic_keyword").alias("topic_keyword"))
    return found.select("topic_id", "n", F.concat_ws("_", "topic_id", "topic_keyword").alias("name"))


def collection_stats(index: DataFrame, name: str, model: str) -> DataFrame:
    return index.agg(F.count("*").alias("documents")).select("documents", F.lit(name).alias("name"), F.lit(model).alias("model"))


def sentiment_trend(stories: DataFrame, unit: str = "day") -> DataFrame:
    """``(period, n, average_sentiment)``."""
    return stories.groupBy(F.date_trunc(unit, F.col("time").cast("timestamp")).cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("sentiment_score"), 6).alias("average_sentiment"))


def topic_timeline(stories: DataFrame, unit: str = "day") -> DataFrame:
    """``(period, topic_keyword, n)`` without outliers."""
    period = F.date_trunc(unit, F.col("time").cast("timestamp")).cast("timestamp_ntz").alias("period")
    return stories.where(is_topic()).groupBy(period, "topic_keyword").agg(F.count("*").alias("n"))


def sentiment_by_topic(stories: DataFrame) -> DataFrame:
    """A row for each topic with its stories of each label and its mean sentiment."""
    labels = ["Positive", "Neutral", "Negative"]
    count = [F.count(F.when(F.col("sentiment_label") == v, 1)).alias(v.lower()) for v in labels]
    return stories.groupBy("topic_keyword").agg(*count, F.round(F.avg("sentiment_score"), 6).alias("average_sentiment"))


def engagement(stories: DataFrame, limit: int = 50) -> DataFrame:
    """Score, comments and sentiment of the best stories."""
    return stories.orderBy(F.desc("score"), "id").limit(limit).select("id", "score", "descendants", "sentiment_score", "sentiment_label")


def period_over_period(stories: DataFrame, unit: str = "day") -> DataFrame:
    """Stories of each period, of the one before, and the change. One row a
    period enters the window, however many stories there are."""
    periods = sentiment_trend(stories, unit)
    before = F.lag("n").over(Window.orderBy("period"))
    return periods.select("period", "n", before.alias("n_before"), (F.col("n") - before).alias("change"))


def keyword_cloud(stories: DataFrame, limit: int = 50, stop_words: tuple[str, ...] = (), text_col: str = "title") -> DataFrame:
    """The most frequent words of titles."""
    word = F.explode(F.split(F.lower(text_col), r"[^\p{L}0-9]+")).alias("word")
    found = stories.select(word).where("word <> ''")
    if stop_words:
        found = found.where(~F.col("word").isin(*stop_words))
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def no_topic_label(title: Column, keyword: Column, valid_titles: int) -> Column:
    """Label of a story whose title is null, or where titles are too few to group."""
    if valid_titles < 2:
        return F.lit(TOO_FEW)
    return F.when(title.isNull(), NO_TOPIC).otherwise(F.coalesce(keyword, F.lit(OUTLIER_TOPIC)))
