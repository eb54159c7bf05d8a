"""What the operators share: tables, components, files in the cluster's folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components
from ..sources.workspace import new_folder, remove, scratch, shared_dir, written, written_at

__all__ = ["arrow_rows", "connected_components", "get", "new_folder", "put", "remove", "scratch", "shared_dir", "table", "trimmed", "written", "written_at"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of ``n`` rows for what is run inside, where rows are wide: both
    the JVM and the Python worker hold a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system at its end:
    Python workers outlive their tasks, and would keep the most that any stage took."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def connected_components(edges: DataFrame, name: str = "components", keep: bool = False) -> DataFrame:
    """Components of the graph of ``edges(src, dst)``: ``(node, component)``, the smallest node reachable."""
    return components(edges.select(edges["src"].alias("a"), edges["dst"].alias("b")), name, keep)


def put(path: str, data: bytes) -> None:
    """Write a whole file under its name or not at all; a repeated task writes it again."""
    store, at = pafs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, at)


def get(path: str) -> bytes:
    store, at = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read()
