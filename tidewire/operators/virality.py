"""Virality: features of a headline and a forest that predicts a high score."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIRAL_SCORE = 100
INPUTS = ["title_length", "_hour", "sentiment_score"]


def features(stories: DataFrame) -> DataFrame:
    """``(id, title_length, hour, sentiment_score, viral)``."""
    return stories.select("id", F.coalesce(F.length("title"), F.lit(0)).alias("title_length"), F.hour("time").alias("hour"), "sentiment_score", F.when(F.col("score") > VIRAL_SCORE, 1).otherwise(0).alias("viral"))


def _ready(rows: DataFrame) -> DataFrame:
    """Nulls as numbers of their own: a story without time has the hour -1, one without sentiment 0."""
    return rows.withColumn("_hour", F.coalesce("hour", F.lit(-1))).withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(0.0)))


def train(rows: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42) -> PipelineModel | None:
    """A forest over all rows; None without rows."""
    if rows.isEmpty():
        return None
    forest = RandomForestClassifier(featuresCol="x", labelCol="viral", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="x"), forest]).fit(_ready(rows))


def predict(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``rows`` with ``viral_probability`` and a ``message`` at a half. Where nothing
    could be learned (no model, or no story was viral), the probability is 0."""
    if model is None:
        return rows.withColumn("viral_probability", F.lit(0.0)).withColumn("message", F.lit("unlikely to go viral"))
    scored = model.transform(_ready(rows)).withColumn("viral_probability", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    message = F.when(F.col("viral_probability") > 0.5, "likely to go viral").otherwise("unlikely to go viral")
    return scored.withColumn("message", message).drop("x", "_hour", "rawPrediction", "probability", "prediction")
