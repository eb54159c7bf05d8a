"""Topics: groups of alike titles, their keywords, outliers.

Titles are linked where their embeddings are alike; components of the
links are topics if they have two members or more, numbered by size, the
rest are outliers. Other methods are density clusters (``density``) and
k-means, which has no outliers. Keywords are the terms of the highest class-based
TF-IDF weight: the share of a term in its topic times ``ln(1 + A / f)``,
with A the mean number of words in a topic and f the term's count in all.
"""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import with_index
from ..functions.tokens import terms
from ..schemas import OUTLIER_ID, OUTLIER_TOPIC, TOO_FEW, require
from . import density
from .graph import components
from .metrics import no_topic_label
from .search import near_pairs

LEAST_SIZE = 2
KEYWORDS = 3


def term_weights(titled: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """``(topic_id, term, weight)`` of titles ``(topic_id, title)``, outliers left out."""
    found = titled.where(F.col("topic_id") != OUTLIER_ID).select("topic_id", terms(F.col("title")).alias("term")).where("term <> ''")
    if stop_words:
        found = found.where(~F.col("term").isin(*stop_words))
    counts = found.groupBy("topic_id", "term").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("topic_id").agg(F.sum("n").alias("size"))
    totals = counts.groupBy("term").agg(F.sum("n").alias("f"))
    # One row: the mean size of a topic.
    mean = F.broadcast(sizes.agg(F.avg("size").alias("mean")))
    weight = F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("f"))
    return counts.join(sizes, "topic_id").join(totals, "term").join(mean, F.lit(True)).select("topic_id", "term", F.round(weight, 9).alias("weight"))


def keywords(titled: DataFrame, stop_words: tuple[str, ...] = (), count: int = KEYWORDS) -> DataFrame:
    """``(topic_id, topic_keyword)``: the first terms joined with ``_``; ties by term."""
    best = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    top = term_weights(titled, stop_words).withColumn("r", F.row_number().over(best)).where(F.col("r") <= count)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"])
    return top.groupBy("topic_id").agg(F.array_join(ordered, "_").alias("topic_keyword"))


def name_topics(stories: DataFrame, named: DataFrame) -> DataFrame:
    """``stories`` with the keyword of their topic: ``Topic_{id}`` where it has
    none, and the outliers' label."""
    fallback = F.when(F.col("topic_id") == OUTLIER_ID, OUTLIER_TOPIC).otherwise(F.concat(F.lit("Topic_"), F.col("topic_id")))
    joined = stories.drop("topic_keyword").join(named, "topic_id", "left")
    return joined.withColumn("topic_keyword", F.coalesce("topic_keyword", fallback))


def by_similarity(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(id, topic_id)`` of ``vectors(id, embedding)`` that belong to a topic."""
    groups = components(near_pairs(vectors, threshold, forest=True))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_SIZE)
    numbered = with_index(sizes, F.desc("size"), F.col("component"), name="number")
    return groups.join(numbered, "component").select(F.col("node").alias("id"), F.col("number").cast("int").alias("topic_id"))


def by_kmeans(vectors: DataFrame, k: int, bisecting: bool = False, seed: int = 1) -> DataFrame:
    """``(id, topic_id)`` by k-means, without outliers."""
    rows = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    maker = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol="x", predictionCol="topic_id")
    return maker.fit(rows).transform(rows).select("id", "topic_id")


def discover(stories: DataFrame, vectors: DataFrame, threshold: float = 0.4, method: str = "similarity", k: int = 10, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """``stories`` with ``topic_id`` and ``topic_keyword``. A failure raises.

    Stories with a null title have no topic; with fewer than two titles in
    all, nothing is grouped and all are labelled so.
    """
    require(stories, "id", "title")
    valid = stories.where("title is not null")
    if (n := valid.limit(2).count()) < 2:
        return stories.withColumn("topic_id", F.lit(OUTLIER_ID)).withColumn("topic_keyword", F.lit(TOO_FEW))
    usable = vectors.join(valid.select("id"), "id", "left_semi")
    methods = {"similarity": lambda: by_similarity(usable, threshold), "density": lambda: density.clusters_of(usable), "kmeans": lambda: by_kmeans(usable, k)}
    groups = methods[method]()
    placed = stories.join(groups, "id", "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(OUTLIER_ID)))
    named = name_topics(placed, keywords(placed.where("title is not null"), stop_words))
    return named.withColumn("topic_keyword", no_topic_label(F.col("title"), F.col("topic_keyword"), n))


def centroid_similarity(vectors: DataFrame) -> DataFrame:
    """``(topic_a, topic_b, similarity)`` of the mean vectors of ``(topic_id, embedding)``."""
    parts = vectors.select("topic_id", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("topic_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norms = means.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    unit = means.join(norms, "topic_id").select("topic_id", "i", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0).alias("u"))
    a, b = unit.select(F.col("topic_id").alias("topic_a"), "i", F.col("u").alias("ua")), unit.select(F.col("topic_id").alias("topic_b"), "i", F.col("u").alias("ub"))
    return a.join(b, "i").where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.round(F.sum(F.col("ua") * F.col("ub")), 6).alias("similarity"))
