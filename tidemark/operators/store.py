"""Tables without MERGE or a pointer: numbered versions that are whole or not there at all.

A version is a snapshot (``v7``) or an increment on those before it (``a8``). It counts from the moment Spark's committer
has left its mark in it, and the newest one is found by listing; so there is no step between two states of a table in
which a reader or the next writer could find neither. One writer at a time is assumed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DONE = "_SUCCESS"
NAME = re.compile(r"([va])(\d+)(?:-([\w.]+))?")


def _plain(tag: str) -> str:
    return re.sub(r"[^\w.]+", ".", tag)


class SnapshotStore:
    """Tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, table: str) -> list[tuple[int, str, str, str]]:
        """Number, kind, tag and folder of the complete versions, in order."""
        jvm, fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        found = []
        for status in fs.listStatus(p):
            m = NAME.fullmatch(status.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), DONE)):
                found.append((int(m[2]), m[1], m[3] or "", status.getPath().toString()))
        return sorted(found)

    def version(self, table: str) -> int:
        """The current version; 0 before the first."""
        found = self._versions(table)
        return found[-1][0] if found else 0

    def snapshot(self, table: str) -> int:
        """The version of the last snapshot; 0 before the first."""
        return max((n for n, kind, *_ in self._versions(table) if kind == "v"), default=0)

    def increments(self, table: str) -> int:
        """How many increments a reader puts on the last snapshot."""
        return self.version(table) - self.snapshot(table)

    def has_tag(self, table: str, tag: str) -> bool:
        return any(have == _plain(tag) for *_, have, _ in self._versions(table)) if tag else False

    def read(self, table: str, version: int | None = None) -> DataFrame:
        upto = [x for x in self._versions(table) if version is None or x[0] <= version]
        start = max((i for i, x in enumerate(upto) if x[1] == "v"), default=0)
        if not upto:
            raise FileNotFoundError(f"{self.root}/{table} has no version{'' if version is None else f' up to {version}'}")
        return self.spark.read.parquet(*[x[3] for x in upto[start:]])

    def publish(self, table: str, df: DataFrame) -> int:
        """Writes the next version as a snapshot. A failed write leaves the current version in place."""
        new = self.version(table) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v{new}")
        return new

    def append(self, table: str, df: DataFrame, tag: str = "") -> int:
        """Writes the next version as an increment; what is stored isn't read. A tag is written once, whoever repeats it."""
        found = self._versions(table)
        tag = _plain(tag)
        for n, _, have, _ in found:
            if tag and have == tag:
                return n
        new = (found[-1][0] if found else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/a{new}{'-' + tag if tag else ''}")
        return new

    def compact(self, table: str, most: int = 64) -> None:
        """Turns more than ``most`` increments into one snapshot."""
        if self.increments(table) > most:
            self.publish(table, self.read(table))

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Deletes what the last ``keep`` snapshots don't need."""
        found = self._versions(table)
        snapshots = [n for n, kind, *_ in found if kind == "v"]
        if len(snapshots) > keep:
            for n, *_, folder in found:
                if n < snapshots[-keep]:
                    _, fs, p = self._fs(folder)
                    fs.delete(p, True)
