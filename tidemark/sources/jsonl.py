"""Datasets of pairs and attempts as JSON lines, and the one JSON file of measured results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.schemas import ATTEMPT_LOG, PAIRS


def read(spark: SparkSession, path: str, schema: StructType, *, strict: bool) -> DataFrame:
    """Rows of JSON lines; a bad line fails the read or, if not ``strict``, is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def pairs(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    return read(spark, path, PAIRS, strict=strict)


def attempt_log(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    return read(spark, path, ATTEMPT_LOG, strict=strict)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write(rows: DataFrame, path: str) -> None:
    """The rows as JSON lines, in place of what was there."""
    rows.write.mode("overwrite").json(path)


def merge_metrics(spark: SparkSession, path: str, owned: dict[str, object]) -> dict[str, object]:
    """Writes one JSON object: the keys of ``owned`` anew, all others carried forward from what stands there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = json.loads(spark.read.option("wholetext", True).text(path).first()[0]) if fs.exists(p) else {}
    after = before | owned
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(after, ensure_ascii=False, sort_keys=True, default=str).encode()))
    out.close()
    return after
