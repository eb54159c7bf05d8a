"""Refresh by streams: snapshots replaced per batch, counts per window, dedup."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RAW_ITEM

INTERVAL = "60 seconds"
ATTEMPTS, WAIT_SECONDS = 3, 5


def item_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed item records as a stream; the schema is that of the batch source."""
    return spark.readStream.schema(RAW_ITEM).json(path)


def retried(work: Callable[[], None], attempts: int = ATTEMPTS, wait: float = WAIT_SECONDS) -> None:
    """Run ``work``; after a failure wait and try again, and raise the last one."""
    for left in range(attempts - 1, -1, -1):
        try:
            return work()
        except Exception:
            if not left:
                raise
            time.sleep(wait)


def refresh(stream: DataFrame, build: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, wait: float = WAIT_SECONDS) -> StreamingQuery:
    """Every minute build the result of the new items and publish it in place of the last.

    ``publish`` must swap after a full write, as the function of that name does,
    so that readers never see half a refresh. A batch is tried three times; then the query fails and starts
    again from its checkpoint. ``once`` takes what has landed and ends.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            retried(lambda: publish(build(batch), number), wait=wait)

    writer = stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def publish(result: DataFrame, folder: str) -> None:
    """Write ``result`` beside the last one, then switch the pointer to it: readers see one or the other."""
    spark = result.sparkSession
    at = f"{folder}/{uuid.uuid4().hex}"
    result.write.parquet(at)
    hadoop = spark._jvm.org.apache.hadoop.fs
    part, pointer = hadoop.Path(f"{at}.pointer"), hadoop.Path(f"{folder}/current")
    store = part.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(part, True)
    out.write(bytearray(at.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(part, pointer, over)


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last published result, or None before the first."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.parquet(spark.read.text(f"{folder}/current").first()[0])


def windowed_counts(stream: DataFrame, time_col: str, *keys: str, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """``(window_start, keys, n)``; the time column must be a TIMESTAMP."""
    timed = stream.withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def deduplicated(stream: DataFrame, id_col: str, time_col: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that has landed, through the stream into a table, read back.

    With mode ``complete`` the last batch's table is the result.
    """
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
