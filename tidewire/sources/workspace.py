"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
#: Open ``scratch`` blocks, the innermost last, each with the tables written in it.
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a
    cluster that would scatter tables over machines, so it raises.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _fallback[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def passing(path: str, keep: bool = False) -> str:
    """``path``, to be removed when ``scratch`` ends, or with ``keep`` the block around it."""
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return path


def written_at(df: DataFrame, name: str, keep: bool = False, by: str | None = None, compression: str | None = None) -> str:
    """Where ``df`` has been written as Parquet, in folders by the column ``by`` if that is given."""
    path = new_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    return passing(path, keep)


def written(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again, so that its lineage ends here.

    Inside ``scratch`` the table is removed when that ends; with ``keep``,
    when the block around it ends. ``compression``: other than the session's, as for whole texts.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written_at(df, name, keep, compression=compression))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end, so what is
    returned from the block must have been written with ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)
