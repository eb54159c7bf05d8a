"""Versions of a table, each committed by one writer.

A version is a small JSON file ``v{number}.json``, written beside and renamed to its name
without overwriting: of two writers of one number, one fails and tries again
from what the other has committed. The rename must be atomic, as on HDFS and local
disks; object stores need a committer of their own.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

ATTEMPTS = 20


class Versions:
    """The committed versions under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        store = self._hadoop.Path(self.folder).getFileSystem(self._conf)
        if not store.exists(self._hadoop.Path(self.folder)):
            return []
        names = [f.getPath().getName() for f in store.listStatus(self._hadoop.Path(self.folder))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def get(self, number: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/v{number}.json").collect()))

    def latest(self) -> tuple[int, dict]:
        """The last version and what it says; 0 and nothing before the first."""
        found = self.numbers()
        return (found[-1], self.get(found[-1])) if found else (0, {})

    def commit(self, number: int, said: dict) -> bool:
        """Commit a version; False if another writer has it already, and then nothing is left behind."""
        part, target = self._path(f"{uuid.uuid4().hex}.part"), self._path(f"v{number}.json")
        store = part.getFileSystem(self._conf)
        out = store.create(part, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(store.getUri(), self._conf).rename(part, target, none)
        except Py4JJavaError as e:
            store.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def update(self, change: Callable[[int, dict], dict]) -> int:
        """Commit what ``change(number, last)`` makes of the last version, again after each lost race; the number."""
        for _ in range(ATTEMPTS):
            last, said = self.latest()
            if self.commit(last + 1, change(last + 1, said)):
                return last + 1
        raise RuntimeError(f"{ATTEMPTS} writers were faster")
