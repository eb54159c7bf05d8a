"""Sharding: arrivals become small immutable shards, merged by size tier.

A store is a folder of Parquet shards with versioned manifests. ``append``
writes an arrival as shards of a bounded number of rows. ``compact`` puts
shards into tiers by the logarithm of their size, joins runs of shards of a
tier up to the target size and writes each run as one file, a run in each
task. Both commit a new manifest: its rows are written first, under a name of
their own, then a file that names them, and that file is renamed to the
version's number, which fails if there is one. So readers see the old or the
new version, of two writers one fails, and a writer that is lost before the
rename leaves nothing but unnamed files. Shards are never changed. After
a commit, folders that older manifests name and the last two don't are
removed with those manifests; what no manifest has ever named is left alone,
as it may be another writer's arrival.

DataFrame functions only: the driver sees one file name per version and the
names of the folders of arrivals and merges, never a row of data or the list
of shards.

Defined cases: rows are kept as they are, nulls, repeats and columns of any
name included (a column may not be named like ``SHARD``, ``RUN`` or ``TASK``
below; that raises). An empty arrival commits a version without new shards.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import with_index
from .common import written

SHARD, RUN, TASK = "_shard_path", "_shard_run", "_shard_task"
#: ``filled`` is what a shard's rows weighed when they arrived: merged files compress
#: better, and a run that was filled to the target once isn't merged again for that.
MANIFEST = "path string, seq long, bytes long, rows long, level int, filled long"
#: Shards are numbered by writing task, with so many numbers for each.
PER_TASK = 100_000
#: Runs are cut within the shards of so many tasks: no task plans all shards.
PLAN_BLOCK = 4096


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """Immutable shards under ``path``, with ``target_bytes`` as the size of a full one.

    ``rows_per_shard`` bounds an arrival's shards, ``fanout`` is the ratio
    between tiers, ``min_run`` the fewest shards worth merging.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, rows_per_shard: int = 50_000, fanout: int = 16, min_run: int = 2, codec: str = "zstd"):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.rows_per_shard, self.fanout, self.min_run, self.codec = target_bytes, rows_per_shard, fanout, min_run, codec

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_versions")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit() and f.getLen())

    def _manifest_at(self, version: int) -> str:
        return self.spark.read.text(f"{self.path}/_versions/{version:08d}").first()[0]

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version, the last by default: ``(path, seq, bytes, rows, level, filled)``."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._manifest_at(known[-1] if version is None else version))

    def commit(self, rows: DataFrame, base: int) -> int:
        """Make ``rows`` the manifest of version ``base + 1``, or raise ``Conflict``."""
        at = f"{self.path}/_manifests/{uuid.uuid4().hex}"
        rows.select("path", "seq", "bytes", "rows", "level", "filled").write.parquet(at)
        name = f"{base + 1:08d}"
        fs, part = self._fs(f"{self.path}/_versions/_{name}-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(at.encode()))
        out.close()
        self._rename(part, name)
        return base + 1

    def _rename(self, part, name: str) -> None:
        """Give a version file its name, unless another has it."""
        fs, to = self._fs(f"{self.path}/_versions/{name}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        none[0] = hadoop.Options.Rename.NONE
        try:
            files.rename(part, to, none)
        except Exception as e:
            if not fs.exists(to):
                raise
            fs.delete(part, False)
            raise Conflict(f"version {int(name)} exists") from e

    def _listed(self, folder: str, level: int) -> DataFrame:
        """Manifest rows of the shards in a folder, by their footers and names."""
        fs, p = self._fs(folder)
        if not any(f.getPath().getName().endswith(".parquet") or f.isDirectory() for f in fs.listStatus(p)):
            return self.spark.createDataFrame([], MANIFEST)
        files = (
            self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
            .groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))
        )
        task = F.coalesce(F.regexp_extract("path", r"part-(\d+)-", 1).try_cast("long"), F.lit(0))
        part = F.coalesce(F.regexp_extract("path", r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
        run = F.regexp_extract("path", RUN + r"=(\d+)", 1).try_cast("long")
        seq = F.coalesce(run, task * PER_TASK + part)
        return files.where("rows > 0").select("path", seq.alias("seq"), "bytes", "rows", F.lit(level).alias("level"), F.col("bytes").alias("filled"))

    def append(self, rows: DataFrame) -> int:
        """Write an arrival as small shards and commit it; the new version."""
        if taken := {SHARD, RUN, TASK} & set(rows.columns):
            raise ValueError(f"columns named {sorted(taken)} are reserved")
        base = (self.versions() or [0])[-1]
        folder = f"{self.path}/arrival-{base + 1:08d}-{uuid.uuid4().hex}"
        rows.write.option("compression", self.codec).option("maxRecordsPerFile", self.rows_per_shard).parquet(folder)
        new = self._listed(folder, 0)
        if base:
            old = self.manifest(base)
            top = old.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
            new = old.unionByName(new.withColumn("seq", F.col("seq") + (top + 1)))
        return self.commit(new, base)

    def plan(self, manifest: DataFrame) -> DataFrame:
        """The runs to merge: ``(path, run)``, each with ``min_run`` shards or more;
        ``run`` is the smallest number among its shards and passes to the merged one.

        A shard filled to half the target or above is full and stays.
        """
        tier = F.floor(F.log(F.greatest(F.col("filled"), F.lit(1))) / math.log(self.fanout))
        small = manifest.where(F.col("filled") < self.target_bytes / 2).select("path", "seq", F.col("filled").alias("bytes"), tier.alias("tier"))
        blocks = Window.partitionBy("tier", F.floor(F.col("seq") / (PLAN_BLOCK * PER_TASK)))
        before = F.sum("bytes").over(blocks.orderBy("seq", "path")) - F.col("bytes")
        binned = small.withColumn("first", F.min("seq").over(blocks)).withColumn("bin", F.floor(before / self.target_bytes))
        run = Window.partitionBy("tier", "first", "bin")
        numbered = binned.withColumn("n", F.count("*").over(run)).withColumn("run", F.min("seq").over(run))
        return numbered.where(F.col("n") >= self.min_run).select("path", "run")

    def compact(self) -> int | None:
        """Merge one round of runs and commit; None if there is nothing to merge."""
        known = self.versions()
        if not known:
            return None
        base, manifest = known[-1], self.manifest()
        at = f"{self.path}/_plans/{uuid.uuid4().hex}"
        self.plan(manifest).write.parquet(at)
        runs = self.spark.read.schema("path string, run long").parquet(at)
        if runs.isEmpty():
            return None
        # The plan is a column of the scan's own file path, so a join (broadcast
        # by Spark while it is small) tells each row its run.
        rows = self._rows(manifest.join(runs, "path", "left_semi")).withColumn(SHARD, F.col("_metadata.file_path"))
        # Runs get numbers without gaps, so that each is dealt to a task of its own.
        numbered = with_index(runs.select("run").distinct(), F.col("run"), name="task")
        n = numbered.count()
        told = runs.join(numbered, "run").select(F.col("path").alias(SHARD), F.col("run").alias(RUN), F.col("task").cast("int").alias(TASK))
        # Written, so that Spark knows that it is small and doesn't shuffle the rows for the join as well.
        told = written(told, "shard-runs")
        dealt = rows.join(told, SHARD).drop(SHARD).repartitionById(n, F.col(TASK)).drop(TASK)
        folder = f"{self.path}/merged-{base + 1:08d}-{uuid.uuid4().hex}"
        dealt.write.option("compression", self.codec).partitionBy(RUN).parquet(folder)
        level = manifest.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] + 1
        filled = manifest.join(runs, "path").groupBy(F.col("run").alias("seq")).agg(F.sum("filled").alias("filled"))
        merged = self._listed(folder, level).drop("filled").join(filled, "seq")
        after = manifest.join(runs, "path", "left_anti").unionByName(merged)
        version = self.commit(after, base)
        self._expire(base)
        return version

    def compact_fully(self, rounds: int = 20) -> int:
        """Rounds until no run is left; the last version."""
        for _ in range(rounds):
            if self.compact() is None:
                break
        return (self.versions() or [0])[-1]

    def _rows(self, manifest: DataFrame) -> DataFrame:
        """Rows of the shards of a manifest. Scans the folders that it names and
        keeps what the manifest lists, by a join on the file's path. Where all arrivals
        were empty, it has none, and the last arrival's folder gives the columns."""
        folders = [r[0] for r in manifest.select(F.regexp_extract("path", r"^(.*/(?:arrival|merged)-[^/]+)/", 1)).distinct().collect()]
        reader = self.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
        if not folders:
            fs, p = self._fs(self.path)
            arrivals = [f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("arrival-")]
            return reader.parquet(f"{self.path}/{max(arrivals)}").where("false")
        return reader.parquet(*sorted(folders))

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """The rows of a version; with ``with_shard`` also the path of their shard."""
        manifest = self.manifest(version)
        rows = self._rows(manifest).withColumn(SHARD, F.col("_metadata.file_path"))
        kept = rows.join(manifest.select(F.col("path").alias(SHARD)), SHARD, "left_semi")
        return kept if with_shard else kept.drop(SHARD)

    def _folders(self, version: int) -> set[str]:
        return {r[0] for r in self.manifest(version).select(F.regexp_extract("path", r"/((?:arrival|merged)-[^/]+)/", 1)).distinct().collect()}

    def _expire(self, base: int) -> None:
        """Remove folders that a manifest older than ``base`` names and the last two
        versions don't, then those manifests."""
        kept = self._folders(base) | self._folders(base + 1)
        for v in [v for v in self.versions() if v < base]:
            manifest = self._manifest_at(v)
            for name in self._folders(v) - kept:
                self._delete(f"{self.path}/{name}")
            # The version goes first: without its manifest it couldn't be read.
            self._delete(f"{self.path}/_versions/{v:08d}")
            self._delete(manifest)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
