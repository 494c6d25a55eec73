"""Spark session and the two things every plan needs from it: a shared folder and a way to cut lineage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tidemark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that all results rely on: UTC, AQE, skew handling, Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k: str(v) for k, v in conf.items()}
    return ship(builder.config(map=settings).getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a fresh temporary folder; on a cluster that would be one machine's own disk,
    so there it is an error.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir() or ""


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no recomputation.

    Partitions keep their number and order.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tables(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a directory of tables."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or what it must become in order to be no column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for a session; they need not share the driver's import path."""
    sc = spark.sparkContext
    if not getattr(sc, "_tidemark_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"  # read by the driver's file server alone
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, Path("tidemark") / path.relative_to(root))
        sc.addPyFile(str(archive))
        sc._tidemark_shipped = True
    return spark
