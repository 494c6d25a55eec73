"""T2: one card for each period and optionally each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import token_estimate
from tidemark.operators.turns import numbered

SCOPES = ("day", "session", "all")


def token_count(summary: Column, facts: Column) -> Column:
    """Tokens of the summary and of every fact."""
    return token_estimate(summary) + F.aggregate(facts, F.lit(0), lambda a, x: a + token_estimate(x))


def latest(cards: DataFrame, order: str = "updated_at") -> DataFrame:
    """One row for each (period, session), the last written; a card without a session is the day's own."""
    cols = [c for c in cards.columns if c not in ("period", "session_id")]
    one = cards.groupBy("period", "session_id").agg(F.max_by(F.struct(*cols), F.struct(order, "id")).alias("r"))
    return one.select("period", "session_id", "r.*").select(*cards.columns)


def upsert(cards: DataFrame, written: DataFrame) -> DataFrame:
    """Cards after a write: summary, facts and token count are new, narrative and threads stay; sessions match null-safe."""
    new = written.select(F.col("period").alias("_p"), F.col("session_id").alias("_s"), F.col("summary").alias("_summary"), F.col("developer_behavior_facts").alias("_facts"), F.col("updated_at").alias("_at"))
    match = (cards["period"] == new["_p"]) & cards["session_id"].eqNullSafe(new["_s"])
    changed = {"summary": F.coalesce("_summary", "summary"), "developer_behavior_facts": F.coalesce("_facts", "developer_behavior_facts"), "updated_at": F.coalesce("_at", "updated_at"), "token_count": F.when(F.col("_p").isNotNull(), token_count(F.col("_summary"), F.col("_facts"))).otherwise(F.col("token_count"))}
    kept = cards.join(new, match, "left").select(*[changed.get(c, F.col(c)).alias(c) for c in cards.columns])
    keys = cards.select(F.col("period").alias("_p"), F.col("session_id").alias("_s"))
    fresh = written.join(keys, (written["period"] == keys["_p"]) & written["session_id"].eqNullSafe(keys["_s"]), "left_anti")
    if "id" not in fresh.columns:
        fresh = numbered(fresh, cards)
    fresh = fresh.withColumn("token_count", token_count(F.col("summary"), F.col("developer_behavior_facts"))).withColumn("generated_by", F.lit("rule"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def listed(cards: DataFrame, *, scope: str = "day", session_id: str | None = None, limit: int = 30) -> DataFrame:
    """Cards by descending period, the day's own before its sessions'."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    if not 1 <= limit <= 365:
        raise ValueError("limit must be 1 to 365")
    if session_id is not None:
        cards = cards.where(F.col("session_id") == session_id)
    elif scope != "all":
        cards = cards.where(F.col("session_id").isNull() if scope == "day" else F.col("session_id").isNotNull())
    return cards.orderBy(F.desc("period"), F.asc_nulls_first("session_id")).limit(limit)


def get(cards: DataFrame, period: str, session_id: str | None = None) -> DataFrame:
    return cards.where((F.col("period") == period) & F.col("session_id").eqNullSafe(F.lit(session_id).cast("string")))


def missing_narrative(cards: DataFrame, limit: int = 365) -> DataFrame:
    """The cards among the latest 365 that nobody has narrated yet."""
    return listed(cards, scope="all", limit=365).where(F.coalesce(F.trim("narrative"), F.lit("")) == "").limit(limit)


def narrate(cards: DataFrame, updates: DataFrame) -> DataFrame:
    """Narratives laid over cards: the rule summary stays, facts are replaced only by highlights that exist."""
    u = updates.select(F.col("period").alias("_p"), F.col("session_id").alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("narrative", "highlights", "open_threads", "generated_by", "model", "extracted_at")])
    match = (cards["period"] == u["_p"]) & cards["session_id"].eqNullSafe(u["_s"])
    hit = F.col("_p").isNotNull()
    changed = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("narrative", "open_threads", "generated_by", "model", "extracted_at")}
    changed["developer_behavior_facts"] = F.when(F.coalesce(F.size("_highlights"), F.lit(0)) > 0, F.col("_highlights")).otherwise(F.col("developer_behavior_facts"))
    return cards.join(u, match, "left").select(*[changed.get(c, F.col(c)).alias(c) for c in cards.columns])


def known_periods(cards: DataFrame) -> DataFrame:
    return cards.where(F.col("session_id").isNull()).select("period").distinct().orderBy("period")
