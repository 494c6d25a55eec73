"""Lines of append-only log files with their byte offsets, and which of them can be read as JSON objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut

LINES = "path string, part long, hot boolean, restarted boolean, n long, start long, end long, line string"
RANGE = 64 << 20  # bytes of a file that one task reads at least
BLOCK = 4 << 20


def discover(spark: SparkSession, root: str, pattern: str = "*.jsonl", *, since: str | None = None) -> DataFrame:
    """Files below ``root`` by name: ``path``, ``modificationTime``, ``length``. They are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")
    return files if since is None else files.where(F.col("modificationTime") >= F.lit(since).cast("timestamp"))


def is_rollout(path: Column) -> Column:
    """Whether a path is a rollout file: in the root, in an archive, or anywhere below the sessions."""
    return path.rlike(r"/rollout-[^/]*\.jsonl$") & (path.rlike(r"/(archived_sessions|sessions(/[^/]+)*)/rollout-[^/]*\.jsonl$") | ~path.rlike(r"/(archived_sessions|sessions)/"))


def _open(path: str):  # noqa: ANN202
    """A file for reading at any place; local paths directly, others by the file system their scheme names."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from urllib.parse import quote

    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(inner)


def _lines_from(f, start: int, stop: int, length: int, whole: bool) -> Iterator[tuple[int, int, bytes]]:  # noqa: ANN001
    """Start, end and bytes of the lines that begin from ``start`` up to ``stop``; none goes beyond ``length``.

    Unless ``whole``, the line in which the byte before ``start`` stands belongs to the range before this one.
    """
    at = start if whole else start - 1
    f.seek(at)
    held = b""
    skip = not whole
    while at < length or held:
        block = f.read(min(BLOCK, length - at - len(held))) if at + len(held) < length else b""
        held += block
        from_ = 0
        while (cut_ := held.find(b"\n", from_)) >= 0:
            if not skip:
                if at + from_ >= stop:
                    return
                yield at + from_, at + cut_ + 1, held[from_ : cut_ + 1]
            skip, from_ = False, cut_ + 1
        held, at = held[from_:], at + from_
        if not block:
            if held and not skip and at < stop:
                yield at, at + len(held), held
            return
        if at + (len(held) if skip else 0) >= stop:
            return


def read_lines(files: DataFrame, cursors: DataFrame | None = None, *, hot_after: str | None = None) -> DataFrame:
    """One row for each line from the cursor of its file on; a cursor beyond the file starts it again.

    A file is read in ranges of bytes by as many tasks as there are bytes to read (``part`` is the start of a range), from
    the cursor up to the length it was listed with, and nothing before the cursor is read. ``n`` is the offset of a
    line, which orders the lines of a file. ``hot`` marks files written after ``hot_after``, which may still grow (or
    comes with the files). Bytes that aren't UTF-8 are replaced.
    """
    hot = F.col("hot") if "hot" in files.columns else F.lit(False) if hot_after is None else F.col("modificationTime") > F.lit(hot_after).cast("timestamp")
    rows = files.select("path", hot.alias("hot"), "length")
    zero = F.lit(0).cast("long")
    if cursors is None:
        rows = rows.withColumn("from", zero)
    else:
        rows = rows.join(cursors.select("path", F.col("bytes_read").alias("from")), "path", "left").withColumn("from", F.coalesce("from", zero))
    rows = rows.withColumn("restarted", F.col("from") > F.col("length")).withColumn("from", F.when(F.col("restarted"), zero).otherwise(F.col("from"))).where(F.col("from") < F.col("length"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("length") - F.col("from")).alias("b")).first()
    tasks = max(1, min(size["n"] + (size["b"] or 0) // RANGE, 8 * (size["b"] or 0) // RANGE + 2 * files.sparkSession.sparkContext.defaultParallelism))
    ranges = rows.withColumn("part", F.explode(F.sequence(F.col("from"), F.col("length") - 1, F.lit(RANGE).cast("long")))).repartition(int(tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out: list[tuple] = []
                held = 0
                with _open(r["path"]) as f:
                    for start, end, raw in _lines_from(f, r["part"], r["part"] + RANGE, r["length"], r["part"] == r["from"]):
                        out.append((r["path"], r["part"], r["hot"], r["restarted"], start, start, end, raw.decode("utf-8", "replace")))
                        held += len(raw)
                        if held > BLOCK:
                            yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, x, strict=True)) for x in out], SCHEMA)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(COLUMNS, x, strict=True)) for x in out], SCHEMA)

    return ranges.select("path", "part", "hot", "restarted", "from", "length").mapInArrow(run, LINES)


SCHEMA = pa.schema([("path", pa.string()), ("part", pa.int64()), ("hot", pa.bool_()), ("restarted", pa.bool_()), ("n", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.string())])
COLUMNS = SCHEMA.names


def carried(rows: DataFrame, **values: tuple[Column, bool]) -> DataFrame:
    """``rows`` with the last known value of each expression in the order ``n`` of their file.

    A value is (expression, whether the row's own counts). Rows are ordered within the ranges of their files only, and a
    row for each range carries what it leaves behind to the next; so a file of any length is no task of its own.
    """
    here = Window.partitionBy("path", "part").orderBy("n")
    left = rows.groupBy("path", "part").agg(*[F.max_by(e, F.when(e.isNotNull(), F.col("n"))).alias(k) for k, (e, _) in values.items()])
    over = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("path", "part", *[F.last(k, ignorenulls=True).over(over).alias(f"_{k}") for k in values])
    for k, (e, own) in values.items():
        rows = rows.withColumn(k, F.last(e, ignorenulls=True).over(here if own else here.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(left, ["path", "part"]).select(*[c for c in rows.columns if c not in values], *[F.coalesce(k, f"_{k}").alias(k) for k in values])


def records(lines: DataFrame, fields: Callable[[Column], list[Column]]) -> tuple[DataFrame, DataFrame]:
    """The ``fields`` of the JSON objects up to the first malformed line of each file, and per file what was read.

    Blank lines are passed over, values that aren't objects count as malformed and are passed over; a line that isn't
    JSON ends its file, which is read up to it. Lines are parsed once: their fields are written to the shared folder, and
    all that follows reads them there.
    """
    body = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    parsed = lines.withColumn("_b", body).withColumn("v", F.when(F.col("_b") != "", F.try_parse_json("_b")))
    kind = F.when(F.col("_b") == "", "blank").when(F.col("v").isNull(), "broken").when(F.schema_of_variant("v").startswith("OBJECT"), "object").otherwise("value")
    parsed = cut(parsed.select("path", "part", "hot", "restarted", "n", "start", "end", kind.alias("_kind"), *fields(F.col("v"))))
    stop = parsed.where(F.col("_kind") == "broken").groupBy("path").agg(F.min("n").alias("_stop"))  # the broken files alone
    seen = parsed.join(stop, "path", "left")
    metrics = seen.groupBy("path").agg(
        F.max("restarted").alias("restarted"),
        F.max(F.when(F.col("_stop").isNull(), F.col("end")).when(F.col("n") == F.col("_stop"), F.col("start"))).alias("bytes_read"),
        F.count_if(F.col("_stop").isNull() | (F.col("n") <= F.col("_stop"))).alias("lines_read"),
        F.count_if((F.col("_stop").isNull() | (F.col("n") <= F.col("_stop"))) & F.col("_kind").isin("broken", "value")).alias("malformed_lines"),
    )
    good = seen.where((F.col("_stop").isNull() | (F.col("n") < F.col("_stop"))) & (F.col("_kind") == "object"))
    return good.drop("_stop", "_kind", "restarted"), metrics


def text_at(v: Column, path: str) -> Column:
    """A string in a variant; null if something else stands there."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))
