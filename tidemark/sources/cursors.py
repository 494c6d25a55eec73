"""How far each file was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.decay import instant


def advance(cursors: DataFrame, metrics: DataFrame, turns: DataFrame, source: str, at) -> DataFrame:  # noqa: ANN001
    """Cursors after a run; the turns of a file add up over runs."""
    n = turns.groupBy("path").agg(F.count("*").alias("_n"), F.max_by("source_key", "line_no").alias("_u"))
    new = metrics.select("path", F.col("bytes_read").alias("_b")).join(n, "path", "left").withColumn("source", F.lit(source))
    both = cursors.join(new, ["source", "path"], "full_outer")
    hit = F.col("_b").isNotNull()
    return both.select(
        "source", "path", F.coalesce("_b", "bytes_read").alias("bytes_read"),
        (F.coalesce("turns_ingested", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int").alias("turns_ingested"),
        F.coalesce("_u", "last_uuid").alias("last_uuid"), F.when(hit, instant(at)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def summary(cursors: DataFrame) -> DataFrame:
    """Files, bytes and turns of each source."""
    return cursors.groupBy("source").agg(F.count("*").alias("files"), F.sum("bytes_read").alias("bytes_read"), F.sum("turns_ingested").alias("turns"), F.max("updated_at").alias("updated_at")).orderBy("source")


def reset(cursors: DataFrame, source: str | None = None) -> DataFrame:
    return cursors.where(F.lit(False)) if source is None else cursors.where(F.col("source") != source)


def unread(files: DataFrame, cursors: DataFrame, *, full: bool = False) -> DataFrame:
    """The files that have grown or shrunk since they were read; all with ``full``."""
    if full:
        return files
    known = cursors.select("path", "bytes_read")
    return files.join(known, "path", "left").where(F.col("bytes_read").isNull() | (F.col("length") != F.col("bytes_read"))).drop("bytes_read")
