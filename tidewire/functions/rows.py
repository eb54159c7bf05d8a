"""Row numbers over a whole table, without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written


def with_index(df: DataFrame, *order: Column, name: str = "index") -> DataFrame:
    """``df`` with a running number from 0 by a total order.

    Rows are dealt out by ranges and numbered within each; each range then
    adds the rows of those before it. The dealt table is written once, so
    counting and numbering see the same ranges.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(placed, "indexed")
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # A row for each range: few enough for one task and for a broadcast.
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    within = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop("_at", "_part", "_before")


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row of ``df`` for each key: the first by ``order``, then by all other columns that can be ordered."""
    rest = [f.name for f in df.schema.fields if f.name not in (key, *order)]
    ordered = F.struct(*order, *(c for c in rest if df.schema[c].dataType.typeName() not in ("map", "variant")))
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), ordered).alias("_row")).select(key, "_row.*")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its files have fewer splits than there are cores, so that
    a small table in one file isn't in one task; a table of many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
