"""The review of one day over all tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cards as card_ops
from tidemark.operators import patterns as pattern_ops

LANES = ("operational", "reflective")


def daily_review(cards: DataFrame, memories: DataFrame, candidates: DataFrame, *, period: str = "latest", today: str, tz: str = "UTC", scan: int = 200) -> DataFrame:
    """One row: ``period``, ``card``, the memories of that day in each lane, and the pending candidates.

    ``latest`` is the newest day card, or today without one. A lane shows what is from that date among its ``scan`` newest
    open memories; dates of memories are taken in ``tz``.
    """
    day_cards = cards.where("session_id is null")
    newest = day_cards.agg(F.coalesce(F.max("period"), F.lit(today)).alias("period")) if period == "latest" else cards.sparkSession.range(1).select(F.lit(period).alias("period"))
    out = newest.join(day_cards.select("period", F.struct("summary", "developer_behavior_facts", "narrative").alias("card")), "period", "left")
    for lane in LANES:
        newest_open = memories.where((F.col("namespace") == lane) & F.col("valid_at").isNull()).orderBy(F.desc("created_at"), F.desc("id")).limit(scan)
        dated = newest_open.select(F.to_date(F.from_utc_timestamp("created_at", tz)).cast("string").alias("period"), F.struct(F.col("id"), F.col("content")).alias("m"))
        out = out.join(dated.groupBy("period").agg(F.sort_array(F.collect_list("m"), asc=False).alias(lane)), "period", "left")  # at most ``scan``
    pending = pattern_ops.listed(candidates, status="pending", limit=100).agg(F.collect_list(F.struct("id", "description")).alias("pending"))
    return out.crossJoin(F.broadcast(pending))  # one row


def banner(cards: DataFrame, memories: DataFrame) -> DataFrame:
    """Open memories and narrated cards, as two counts."""
    told = F.coalesce(F.trim("narrative"), F.lit("")) != ""
    a = memories.agg(F.count_if(F.col("valid_at").isNull()).alias("open_memories"))
    b = cards.agg(F.count_if(told & (F.col("generated_by") != "rule")).alias("narrated_cards"))
    return a.crossJoin(F.broadcast(b))  # one row each


def latest_cards(cards: DataFrame, limit: int = 30) -> DataFrame:
    return card_ops.listed(cards, limit=limit)
