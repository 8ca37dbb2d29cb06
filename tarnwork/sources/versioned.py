"""A Parquet table whose content is replaced as a whole: each commit writes a folder of its own, then a log entry that names it.

Entry n can be made once only, so of two commits that start from the same version one fails and nothing is overwritten.
Readers resolve the last entry once, so they see the old or the new content, never a mixture. Old versions stay for time
travel, and for reading what changed between two of them, until ``expire``. Any file system that Hadoop knows will do.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tarnwork.operators.dml import snapshot_changes_as_feed


class ConcurrentCommit(RuntimeError):
    """Another commit was made since this one began."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that can be read, in order."""
        fs, log = self._fs(), self._at("log")
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int | None:
        """The current version; None before the first commit."""
        return max(self.versions(), default=None)

    def _folder(self, version: int) -> str:
        return f"{self.path}/{self.spark.read.text(f'{self.path}/log/{version:08d}').first()[0]}"

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v is None or v not in self.versions():
            raise FileNotFoundError(f"{self.path} has no version {'yet' if v is None else v}")
        return self.spark.read.parquet(self._folder(v))

    def commit(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write ``df`` as the next version and make it current; ``df`` may read this table. A failed write changes nothing; if
        another commit came first, ``ConcurrentCommit`` is raised and ``df`` is discarded."""
        v = (self.version() or 0) + 1
        folder = f"v{v:08d}-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{folder}")
        fs, jvm = self._fs(), self.spark._jvm
        tmp, at = self._at(f"log/next-{uuid.uuid4().hex}"), self._at(f"log/{v:08d}")
        out = fs.create(tmp, False)
        out.write(folder.encode())
        out.close()
        conf = self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(at), never)
        except Exception as e:
            fs.delete(tmp, False)
            fs.delete(self._at(folder), True)
            raise ConcurrentCommit(f"version {v} of {self.path} is taken") from e
        return v

    def changes(self, start: int, end: int | None, keys: list[str], cols: list[str]) -> DataFrame:
        """The change feed of the versions from ``start`` to ``end`` (default: the current), both included: keys, cols,
        ``_change_type`` and ``_commit_version``. The first version inserts all its rows."""
        top = self.version() if end is None else end
        if top is None or start > top:
            raise FileNotFoundError(f"{self.path} has no versions from {start} on")
        have = [v for v in self.versions() if start <= v <= top]
        old = lambda v: self.read(v - 1) if v > 1 else self.read(v).limit(0)
        return reduce(DataFrame.unionByName, [snapshot_changes_as_feed(old(v), self.read(v), keys, cols, v) for v in have])

    def expire(self, keep: int) -> None:
        """Drop all but the newest ``keep`` versions; the current one always stays."""
        fs = self._fs()
        for old in self.versions()[: -max(keep, 1)]:
            folder = self._folder(old)
            fs.delete(self._at(f"log/{old:08d}"), False)
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def drop(self) -> None:
        """Delete the table with all its versions."""
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)
