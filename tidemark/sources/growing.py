"""A streaming source of log files that grow: its offset says how far each file had grown, so a file is seen again.

Spark's own file source looks at a path once. Here a row is emitted for each file that is new, longer, shorter, written
again or no longer being written since the last batch; where reading goes on is the business of the cursors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = "path string, modificationTime timestamp, length long, hot boolean"


def grown_files(spark: SparkSession, root: str, pattern: str = "*.jsonl", *, hot_seconds: float = 60.0) -> DataFrame:
    """A stream of ``path``, ``modificationTime``, ``length`` and ``hot`` (written within ``hot_seconds``) of changed files.

    The offset is one entry for each file below ``root``; it is listed by the driver, as every file source is.
    """
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    # The classes live in here so that they are sent by value: the driver's reader process needs nothing installed.
    class Part(InputPartition):
        def __init__(self, rows: list) -> None:
            self.rows = rows

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.options = options

        def initialOffset(self) -> dict:  # noqa: N802
            return {}

        def latestOffset(self) -> dict:  # noqa: N802
            import fnmatch
            import time

            from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem

            root_, pattern_, hot = self.options["path"], self.options["pattern"], float(self.options["hot"])
            fs, inner, scheme = (LocalFileSystem(), root_.removeprefix("file:"), "file:") if "://" not in root_ or root_.startswith("file:") else (*FileSystem.from_uri(root_), root_.split("://")[0] + "://")
            found = {}
            for f in fs.get_file_info(FileSelector(inner.rstrip("/") or "/", recursive=True, allow_not_found=True)):
                if f.type == FileType.File and fnmatch.fnmatch(f.base_name, pattern_):
                    at = int(f.mtime.timestamp() * 1000) if f.mtime else 0
                    found[scheme + f.path] = [f.size, at, time.time() - at / 1000 <= hot]
            return found

        def partitions(self, start: dict, end: dict) -> list:
            changed = [(p, *x) for p, x in sorted(end.items()) if start.get(p) != x]
            return [Part(changed[i : i + 1000]) for i in range(0, len(changed), 1000)]

        def read(self, partition):  # noqa: ANN001, ANN202
            import datetime as dt

            for path, size, at, hot in partition.rows:
                yield path, dt.datetime.fromtimestamp(at / 1000, dt.UTC), size, hot

    class GrowingFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_growing_files"

        def schema(self) -> str:
            return "path string, modificationTime timestamp, length long, hot boolean"

        def streamReader(self, schema):  # noqa: ANN001, ANN202, N802
            return Reader(dict(self.options))

    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("tidemark_growing_files").option("pattern", pattern).option("hot", str(hot_seconds)).load(root)
