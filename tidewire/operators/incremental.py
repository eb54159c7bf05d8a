"""An index that is brought up to date instead of built anew.

The index is a chain of segments, each a written table of ``(id, digest,
version, embedding)`` and of the texts' other columns, and of tombstones ``(id,
version)``: a row counts unless a later version has a tombstone of its id. An update joins
the digests of what is there with those of the new texts, a full outer join of ids and
digests alone; what is new or changed is embedded and becomes a segment, what is changed or
gone gets tombstones. Texts that stay as they are aren't embedded, and where no
text differs nothing is written: the fingerprint of all digests decides that
before the join.

A version is committed whole or not at all (``commits``). A writer that lost the race
for a version starts again from the winner's.

Defined cases: rows without an id are left out, and of rows of one id that
with the smallest digest counts. A null text is a text of its own. An empty table
removes all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import first_of
from ..sources.commits import Versions
from ..sources.snapshots import fingerprint_of
from ..sources.workspace import remove, scratch, written

#: Segments beyond which an update merges all of them into one.
SEGMENTS = 16


def text_digest(text_col: str):
    return F.md5(F.encode(F.coalesce(F.concat(F.lit("t"), F.col(text_col)), F.lit("n")), "utf-8"))


class Index:
    """An index under a folder; ``embed`` gives a table of texts its column ``embedding``."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[DataFrame], DataFrame], text_col: str = "document"):
        self.spark, self.folder, self.embed, self.text_col = spark, folder.rstrip("/"), embed, text_col
        self.versions = Versions(spark, f"{self.folder}/versions")

    def _alive(self, said: dict) -> DataFrame | None:
        """The rows that count in a version, by merging its segments and tombstones as they are read."""
        if not said.get("segments"):
            return None
        rows = self.spark.read.parquet(*said["segments"])
        if not said["tombstones"]:
            return rows
        dead = self.spark.read.parquet(*said["tombstones"]).groupBy("id").agg(F.max("version").alias("dead"))
        return rows.join(dead, "id", "left").where("dead is null or version >= dead").drop("dead")

    def read(self) -> DataFrame | None:
        """The index as last committed, or None before the first update."""
        return self._alive(self.versions.latest()[1])

    def changes(self, texts: DataFrame, said: dict) -> DataFrame:
        """``(id, digest, kind)`` of what differs from a version: inserted, changed or removed."""
        new = texts.select("id", F.col("digest").alias("new"))
        there = self._alive(said)
        old = there.select("id", F.col("digest").alias("old")) if there is not None else new.select("id", F.col("new").alias("old")).limit(0)
        both = new.join(old, "id", "full").where("new is null or old is null or new <> old")
        kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "removed").otherwise("changed")
        return both.select("id", F.col("new").alias("digest"), kind.alias("kind"))

    def update(self, texts: DataFrame) -> int:
        """Bring the index to ``texts(id, text, ...)``; the version that holds them."""
        rows = first_of(texts.where("id is not null").withColumn("digest", text_digest(self.text_col)), "id", "digest")
        with scratch(self.spark):
            rows = written(rows, "texts")
            mark = fingerprint_of(rows.select(F.md5(F.concat_ws(":", "id", "digest")).alias("digest"))).first()[0]
            last, said = self.versions.latest()
            if last and said["fingerprint"] == mark:
                return last
            return self.versions.update(lambda number, now: self._segment(rows, number, now, mark))

    def _segment(self, rows: DataFrame, number: int, said: dict, mark: str) -> dict:
        at = f"{self.folder}/{number}-{uuid.uuid4().hex}"
        found = written(self.changes(rows, said), "changes")
        fresh = rows.join(found.where("kind <> 'removed'").select("id"), "id", "left_semi")
        self.embed(fresh).withColumn("version", F.lit(number).cast("long")).write.parquet(f"{at}/rows")
        dead = found.where("kind <> 'inserted'").select("id", F.lit(number).cast("long").alias("version"))
        dead.write.parquet(f"{at}/tombstones")
        segments, tombstones = [*said.get("segments", []), f"{at}/rows"], [*said.get("tombstones", []), f"{at}/tombstones"]
        out = {"segments": segments, "tombstones": tombstones, "fingerprint": mark}
        if len(segments) > SEGMENTS:
            self._alive(out).write.parquet(f"{at}/merged")
            out |= {"segments": [f"{at}/merged"], "tombstones": []}
        return out

    def expire(self, keep: int = 2) -> None:
        """Remove the tables that only versions before the last ``keep`` use."""
        numbers = self.versions.numbers()
        used = {p for n in numbers[-keep:] for k in ("segments", "tombstones") for p in self.versions.get(n)[k]}
        for n in numbers[:-keep]:
            said = self.versions.get(n)
            for path in {*said["segments"], *said["tombstones"]} - used:
                remove(self.spark, path)
