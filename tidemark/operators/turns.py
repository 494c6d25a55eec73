"""T1: windows, ranges and keyed upserts of conversation turns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import token_estimate
from tidemark.session import cut

ROLES = ("user", "assistant", "tool")


SALTS = 64


def latest_ids(turns: DataFrame, n: int) -> DataFrame:
    """``session_id``, ``id``, ``recency`` (1 for the latest) of the latest ``n`` turns of each session.

    Each of ``SALTS`` parts of a session keeps its latest ``n`` first, so a session of any size is ranked over few rows.
    """
    order = [F.desc("created_at"), F.desc("id")]
    thin = turns.select("session_id", "id", "created_at").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = thin.withColumn("_r", F.row_number().over(Window.partitionBy("session_id", "_s").orderBy(*order))).where(F.col("_r") <= n)
    ranked = few.withColumn("recency", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))
    return ranked.where(F.col("recency") <= n).select("session_id", "id", "recency")


def session_window(turns: DataFrame, n: int = 12) -> DataFrame:
    """The latest ``n`` turns of each session; ``position`` counts from the oldest of them."""
    kept = latest_ids(turns, n)
    size = kept.groupBy("session_id").agg(F.max("recency").alias("_n"))
    placed = kept.join(size, kept["session_id"].eqNullSafe(size["session_id"])).select("id", (F.col("_n") - F.col("recency") + 1).alias("position"))
    return turns.join(placed, "id")


def evicted(turns: DataFrame, n: int = 12) -> DataFrame:
    """The turns that are no longer in the window of their session."""
    return turns.join(latest_ids(turns, n).select("id"), "id", "left_anti")


def buffer_stats(turns: DataFrame, n: int = 12) -> DataFrame:
    """Turns and tokens in the window of each session, and how many turns left it."""
    inside = latest_ids(turns, n).select("id", F.lit(True).alias("_in"))
    rows = turns.select("id", "session_id", "token_count").join(inside, "id", "left")
    return rows.groupBy("session_id").agg(
        F.count_if("_in").alias("turns"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("token_count"))), F.lit(0)).alias("tokens"),
        F.greatest(F.lit(0).cast("long"), F.count("*") - n).alias("evicted"),
    )


def in_range(start: dt.datetime | str, end: dt.datetime | str) -> Column:
    at = F.col("created_at")
    return (at >= F.lit(str(start)).cast("timestamp")) & (at < F.lit(str(end)).cast("timestamp"))


def between(turns: DataFrame, start: dt.datetime | str, end: dt.datetime | str, limit: int = 40) -> DataFrame:
    """The first ``limit`` turns from ``start`` up to, not including, ``end``."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    return turns.where(in_range(start, end)).orderBy("created_at", "id").limit(limit)


def numbered(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` with ids above all stored ones; unique and increasing by partition, not without gaps."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return rows.withColumn("_k", F.monotonically_increasing_id() + 1).crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_k")).drop("_top", "_k")  # one row


def filled(new: DataFrame) -> DataFrame:
    """Turns with their token counts filled in."""
    return new.withColumn("token_count", F.coalesce("token_count", token_estimate(F.col("content"))))


def append(turns: DataFrame, new: DataFrame) -> DataFrame:
    """``turns`` with further rows; ids go on from the largest, and token counts are filled in."""
    return turns.unionByName(numbered(filled(new), turns), allowMissingColumns=True)


def changes(stored: DataFrame, batch: DataFrame, order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """The rows of a keyed batch that are new, and the stored rows that it alters, as they are afterwards.

    The first row of a key in the batch counts. A stored row takes project and branch from the batch where the batch has
    them, and tool names only where it has none. Rows without a key are always new.
    """
    keyed = batch.where(F.col("source_key").isNotNull())
    once = keyed.groupBy("source_key").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "source_key"]), F.struct(F.col(order), F.xxhash64(*batch.columns))).alias("r")).select("source_key", "r.*")
    once = cut(once.select(*batch.columns).unionByName(batch.where(F.col("source_key").isNull())))
    known = stored.where(F.col("source_key").isNotNull()).select("source_key")
    new = once.join(known, "source_key", "left_anti").select(*batch.columns)
    fills = once.where(F.col("source_key").isNotNull()).select(F.col("source_key").alias("_key"), F.col("project").alias("_p"), F.col("git_branch").alias("_b"), F.col("tool_names").alias("_t"))
    bare = F.coalesce(F.size("tool_names"), F.lit(0)) <= 0
    fresh = (F.col("_p").isNotNull() & ~F.col("_p").eqNullSafe(F.col("project"))) | (F.col("_b").isNotNull() & ~F.col("_b").eqNullSafe(F.col("git_branch"))) | (bare & F.col("_t").isNotNull() & ~F.col("_t").eqNullSafe(F.col("tool_names")))
    after = {"project": F.coalesce("_p", "project"), "git_branch": F.coalesce("_b", "git_branch"), "tool_names": F.when(bare & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("tool_names"))}
    altered = stored.join(fills, stored["source_key"] == F.col("_key")).where(fresh).select(*[after.get(c, F.col(c)).alias(c) for c in stored.columns])
    return new, altered


def upsert(stored: DataFrame, batch: DataFrame, order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """The store after a keyed batch, and the rows of the batch that were new; see :func:`changes`."""
    new, altered = changes(stored, batch, order)
    altered = cut(altered)
    ranked = numbered(new, stored)
    kept = stored.join(altered.select("id"), "id", "left_anti").unionByName(altered)
    return kept.unionByName(ranked.select(*[c for c in stored.columns if c in ranked.columns]), allowMissingColumns=True), new


def known_roles(turns: DataFrame) -> DataFrame:
    """Turns whose role, trimmed and in lower case, is one of the three."""
    role = F.lower(F.trim("role"))
    return turns.withColumn("role", role).where(role.isin(*ROLES))
