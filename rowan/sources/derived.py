"""Tables derived from sources, kept as Parquet under a key of what they were made of."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class DerivedTables:
    """A folder of derived tables in shared storage: <key>/data and <key>/manifest.json.

    The key is a hash of the description (paths, sizes and times of source files, operator, parameters). A table is built once under a
    name of its own and renamed when it is complete, so runs at the same time never see half of one, and the first to finish wins. When the folder exceeds
    ``most_bytes``, the tables used longest ago are deleted down to ``target`` of it, the one just asked for never.
    """

    def __init__(self, spark: SparkSession, root: str, most_bytes: int = 5 << 30, target: float = 0.8):
        if not 0 < target <= 1:
            raise ValueError("target must be over 0 and at most 1")
        self.spark, self.root, self.most_bytes, self.target = spark, root.rstrip("/"), most_bytes, target
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """Name, size and time of change of a source's files, for a description."""
        found = self._fs.globStatus(self._path(path)) or []
        out, todo = [], list(found)
        while todo:
            f = todo.pop()
            if f.isDirectory():
                todo += list(self._fs.listStatus(f.getPath()))
            else:
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def key(self, description: dict) -> str:
        return hashlib.sha256(json.dumps(description, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def get(self, description: dict, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a description; built and kept if it is not there or not complete."""
        at = f"{self.root}/{self.key(description)}"
        if not self._fs.exists(self._path(f"{at}/manifest.json")):
            temporary = f"{self.root}/.build-{uuid.uuid4().hex}"
            try:
                build().write.parquet(f"{temporary}/data")
                self._write(f"{temporary}/manifest.json", json.dumps(description, sort_keys=True, default=str))
                if not self._fs.exists(self._path(at)):
                    self._fs.rename(self._path(temporary), self._path(at))
            finally:
                self._fs.delete(self._path(temporary), True)
        self._write(f"{at}/used", str(time.time()))
        self._collect(at)
        return self.spark.read.parquet(f"{at}/data")

    def _write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _collect(self, keep: str) -> None:
        entries = []
        for f in self._fs.listStatus(self._path(self.root)):
            if f.getPath().getName()[:1] != ".":
                used = self._path(f"{f.getPath().toString()}/used")
                entries.append((self._fs.getFileStatus(used).getModificationTime() if self._fs.exists(used) else 0, f.getPath(), self._fs.getContentSummary(f.getPath()).getLength()))
        total = sum(n for *_, n in entries)
        if total <= self.most_bytes:
            return
        for _, path, n in sorted(entries, key=lambda e: e[0]):
            if total <= self.most_bytes * self.target:
                break
            if path.getName() != keep.rsplit("/", 1)[1]:
                self._fs.delete(path, True)
                total -= n
