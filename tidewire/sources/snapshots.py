"""Snapshots of story tables: manifest, time to live, fingerprint, versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import snapshot_key
from ..schemas import MANIFEST, require
from .commits import Versions

TTL_HOURS = 1.0
INDEX_SECONDS = 3600


def valid_until(now: Column, ttl_hours: float = TTL_HOURS) -> Column:
    """Whether a manifest row is fresh: younger than the time to live, so that 0 is never valid."""
    return now - F.col("timestamp") < F.lit(ttl_hours * 3600)


def index_valid(now: Column, built: Column, stored: Column, current: Column, force: bool = False) -> Column:
    """Whether an index can be kept: at most an hour old, limit included, and of the same data."""
    return F.lit(False) if force else (now - built <= INDEX_SECONDS) & (stored == current)


def row_digest(stories: DataFrame) -> Column:
    require(stories, "title", "score", "time")
    return F.md5(F.encode(F.concat_ws("|", F.coalesce(F.trim("title"), F.lit("")), F.coalesce(F.col("score").cast("string"), F.lit("")), F.coalesce(F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit(""))), "utf-8"))


def fingerprint(stories: DataFrame) -> DataFrame:
    """One row ``(fingerprint)``, the same whatever the order of the rows.

    A number for each row is summed, so partial sums do the work and no list
    of rows is built: count, and the sums of both halves of each row's md5.
    """
    digest = row_digest(stories)
    return fingerprint_of(stories.select(digest.alias("digest")))


def fingerprint_of(digests: DataFrame) -> DataFrame:
    half = lambda at: F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = digests.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b"))
    return sums.select(F.md5(F.encode(F.concat_ws(":", "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), "utf-8")).alias("fingerprint"))


def text_fingerprint(texts: DataFrame, text_col: str) -> DataFrame:
    return fingerprint_of(texts.select(F.md5(F.encode(F.coalesce(F.trim(text_col), F.lit("")), "utf-8")).alias("digest")))


class Snapshots:
    """Snapshots under a folder: tables in Parquet and a manifest row each, in JSON."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def manifests(self) -> DataFrame:
        """All manifest rows; broken ones are left out."""
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        raw = self.spark.read.schema(f"{MANIFEST}, _corrupt_record STRING").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(f"{self.path}/manifest")
        return raw.where("_corrupt_record is null and cache_key is not null and path is not null").drop("_corrupt_record")

    def save(self, stories: DataFrame, limit: int, analysis_type: str, now: float) -> bool:
        """Write a snapshot, then commit its manifest row under a version of its own; an empty table is refused."""
        if stories.isEmpty():
            return False
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        stories.write.parquet(at)
        n = self.spark.read.parquet(at).count()
        key = self.spark.range(1).select(snapshot_key(F.lit(limit), F.lit(analysis_type))).first()[0]
        row = {"timestamp": float(now), "limit": limit, "analysis_type": analysis_type, "stories_count": n, "columns": stories.columns, "cache_key": key, "path": at}
        Versions(self.spark, f"{self.path}/manifest").update(lambda number, _: row | {"version": number})
        return True

    def load(self, limit: int, analysis_type: str, now: float, ttl_hours: float = TTL_HOURS) -> DataFrame | None:
        """The newest fresh snapshot, or None."""
        found = self.manifests().where((F.col("limit") == limit) & (F.col("analysis_type") == analysis_type)).where(valid_until(F.lit(now), ttl_hours))
        best = found.orderBy(F.desc("timestamp"), F.desc("version")).select("path").first()
        return self.spark.read.parquet(best.path) if best and self._exists(best.path) else None

    def catalogue(self, now: float, ttl_hours: float = TTL_HOURS) -> DataFrame:
        return catalogue(self.manifests(), now, ttl_hours)


def catalogue(manifests: DataFrame, now: float, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """``(limit, analysis_type, stories_count, valid, age_hours)`` of every snapshot."""
    age = F.round((F.lit(now) - F.col("timestamp")) / 3600, 6)
    return manifests.select("limit", "analysis_type", "stories_count", valid_until(F.lit(now), ttl_hours).alias("valid"), age.alias("age_hours"))
