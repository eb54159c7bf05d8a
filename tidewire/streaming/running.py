"""Results that a stream keeps up to date without reading its history.

After each batch a small state is committed together with the batch's number (``commits``):
a batch that comes again after a failure finds its number taken and changes
nothing. States are tables of one row for each key, made of the last state and
the batch's own sums; the events before are never read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Versions
from ..sources.workspace import remove


class _Kept:
    """A state under a folder, with what its last commit says."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, f"{self.folder}/versions")

    def _step(self, number: int, make: Callable[[dict, str], dict]) -> bool:
        """Commit what ``make(last, path)`` says of a batch, unless it or a later one is committed."""
        version, said = self.versions.latest()
        if version and said["batch"] >= number:
            return False
        at = f"{self.folder}/{number}-{uuid.uuid4().hex}"
        if not self.versions.commit(version + 1, make(said, at) | {"batch": number}):
            remove(self.spark, at)
            return False
        if version > 1 and (old := self.versions.get(version - 1).get("state")):
            remove(self.spark, old)  # readers may still have the last state, but not the one before
        return True

    def state(self) -> DataFrame | None:
        """The state of the last batch, or None before the first."""
        path = self.versions.latest()[1].get("state")
        return self.spark.read.parquet(path) if path else None


class Totals(_Kept):
    """Counts and sums by keys over all batches: ``keys``, ``n`` and the sums of columns.

    Nulls are keys too; a sum over nulls alone is 0.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], sums: list[str]):
        super().__init__(spark, folder)
        self.keys, self.sums = keys, sums

    def add(self, batch: DataFrame, number: int) -> bool:
        """Take a batch in, once; whether it was new."""
        own = batch.groupBy(*self.keys).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self.sums))

        def make(said: dict, at: str) -> dict:
            both = self.spark.read.parquet(said["state"]).unionByName(own) if said else own
            both.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in ["n", *self.sums])).write.parquet(at)
            return {"state": at}

        return self._step(number, make)


class ClosingWindows(_Kept):
    """Counts by window and keys; windows close once the watermark has passed their end.

    The watermark is the latest time of all batches before, less ``late``. A row
    of a window that has closed is kept in the table of late rows, with its batch.
    Open windows are the state; closed ones are written once and leave it. Rows
    without a time have no window: they are late rows.
    """

    def __init__(self, spark: SparkSession, folder: str, time_col: str, keys: list[str], window: str = "1 day", late: str = "10 minutes"):
        super().__init__(spark, folder)
        self.time_col, self.keys, self.window, self.late_by = time_col, keys, window, late

    def add(self, batch: DataFrame, number: int) -> bool:
        """Take a batch in, once; whether it was new."""
        timed = batch.withColumn("_window", F.window(self.time_col, self.window)) if not batch.isEmpty() else batch.withColumn("_window", F.lit(None).cast("struct<start:timestamp,end:timestamp>"))
        # The window function leaves out rows without a time.
        loose = batch.where(F.col(self.time_col).isNull())

        def make(said: dict, at: str) -> dict:
            mark = said.get("watermark")
            passed: Column = F.col("_window.end") <= F.timestamp_micros(F.lit(mark)) if mark is not None else F.lit(False)
            timed.where(passed).drop("_window").unionByName(loose).write.mode("overwrite").parquet(f"{self.folder}/late/batch={number}")
            own = timed.where(~passed).groupBy(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *self.keys).agg(F.count("*").alias("n"))
            both = self.spark.read.parquet(said["state"]).unionByName(own) if said else own
            latest = batch.agg(F.unix_micros(F.max(self.time_col) - F.expr(f"interval {self.late_by}"))).first()[0]
            now = max((v for v in (mark, latest) if v is not None), default=None)
            counts = both.groupBy("window_start", "window_end", *self.keys).agg(F.sum("n").alias("n"))
            over: Column = F.col("window_end") <= F.timestamp_micros(F.lit(now)) if now is not None else F.lit(False)
            counts.where(over).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={number}")
            counts.where(~over).write.parquet(at)
            return {"state": at, "watermark": now}

        return self._step(number, make)

    def _committed(self, kind: str) -> DataFrame | None:
        version, said = self.versions.latest()
        if not version:
            return None
        # A batch that was written but not committed isn't read.
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}").where(F.col("batch") <= said["batch"])

    def closed(self) -> DataFrame | None:
        """Windows that have closed, with the batch that closed them."""
        return self._committed("closed")

    def late(self) -> DataFrame | None:
        """Rows that came after their window had closed, as they came, with their batch."""
        return self._committed("late")

    def counts(self) -> DataFrame | None:
        """All windows, closed and open: ``window_start, keys, n``."""
        columns = ["window_start", *self.keys, "n"]
        return None if (closed := self.closed()) is None else closed.select(columns).union(self.state().select(columns))
