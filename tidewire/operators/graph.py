"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import new_folder, passing, remove


def components(edges: DataFrame, name: str = "components", keep: bool = False) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``; the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one and
    then its smaller neighbours likewise: two aggregations with map-side
    combine and two joins, and no neighbourhood is ever collected. Every
    round is a written table, so a lost executor repeats one round at most;
    tables of earlier rounds are removed. Loops and edges with a null end
    are ignored, a node without any other edge has no row, and empty edges
    give an empty result. ``keep`` is that of ``written``.
    """
    spark = edges.sparkSession
    base = passing(new_folder(spark, name), keep)

    def at(df: DataFrame, number: int) -> DataFrame:
        df.write.parquet(f"{base}/{number}")
        return spark.read.schema(df.schema).parquet(f"{base}/{number}")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0)
    last, done = mark(now), 0
    while last[0]:
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done += 1
        now = at(small.union(root).distinct(), done)
        found = mark(now)
        remove(spark, f"{base}/{done - 1}")
        if found == last:
            break
        last = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
