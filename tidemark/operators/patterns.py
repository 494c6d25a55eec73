"""Pattern candidates: mined from the facts of day cards, and their way to a confirmed memory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.decay import instant
from tidemark.functions.text import label_key, list_field

STATUSES = ("pending", "confirmed", "edited", "rejected")


def _events(kind: str, items: Column, say: Column) -> Column:
    """An array of (context, summary) of the labels that are left after normalising."""
    made = F.transform(items, lambda x: F.struct(F.concat(F.lit(f"{kind}:"), label_key(x)).alias("context"), F.concat(say, x).alias("summary")))
    return F.filter(made, lambda e: e["context"] != f"{kind}:")


def observations(cards: DataFrame) -> DataFrame:
    """``context``, ``period``, ``source_id``, ``summary``, ``ord`` of what the facts of day cards show.

    Only periods that are calendar dates count.
    """
    day = F.when(F.col("period").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("period", "yyyy-MM-dd"))
    rows = cards.where("session_id is null").withColumn("_d", day).where("_d is not null").select("id", "period", F.posexplode("developer_behavior_facts").alias("idx", "fact"))
    fact = F.col("fact")

    def seen(what: str) -> Column:
        return F.concat(F.lit(f"{what} on "), F.col("period"), F.lit(": "))

    tools = F.regexp_extract_all(F.regexp_replace(fact, r"(?s)^[^:]*:", ""), F.lit(r"[^,×]+\s*×\d+"), F.lit(0))
    tools = F.transform(tools, lambda x: F.struct(F.trim(F.regexp_extract(x, r"([^,×]+)\s*×(\d+)", 1)).alias("t"), F.regexp_extract(x, r"([^,×]+)\s*×(\d+)", 2).cast("int").cast("string").alias("n")))
    tool_events = F.filter(F.transform(tools, lambda x: F.struct(F.concat(F.lit("tool:"), label_key(x["t"])).alias("context"), F.concat(seen("Tool usage"), x["t"], F.lit(" ×"), x["n"]).alias("summary"))), lambda e: e["context"] != "tool:")
    late = F.array(F.struct(F.lit("pattern:late_hours").alias("context"), F.concat(F.lit("Observed past-midnight work on "), F.col("period")).alias("summary")))
    events = (
        F.when(fact.startswith("Projects touched:"), _events("project", list_field(fact), seen("Project seen")))
        .when(fact.startswith("Tool calls:"), tool_events)
        .when(fact.startswith("Git branches:"), _events("git_branch", list_field(fact), seen("Git branch seen")))
        .when(fact.startswith("Sources:"), _events("source", list_field(fact), seen("Source seen")))
        .when(F.contains(fact, F.lit("Worked past midnight")), late)
    )
    out = rows.where(events.isNotNull()).select("id", "period", "idx", F.posexplode(events).alias("pos", "e"))
    return out.select("e.context", "period", F.format_string("t2:%d:%d", "id", "idx").alias("source_id"), "e.summary", F.struct("period", "id", "idx", "pos").alias("ord"))


def _description(context: Column) -> Column:
    label = F.replace(F.regexp_replace(context, r"^[^:]*:", ""), F.lit("-"), F.lit(" "))
    return (
        F.when(context.startswith("project:"), F.concat(F.lit("Repeated project work tied to "), label, F.lit(".")))
        .when(context.startswith("tool:"), F.concat(F.lit("Frequent tool preference around "), label, F.lit(".")))
        .when(context.startswith("git_branch:"), F.concat(F.lit("Recurring branch context: "), label, F.lit(".")))
        .otherwise(F.concat(F.lit("Observed repeated signal: "), F.replace(context, F.lit("_"), F.lit(" ")), F.lit(" over time.")))
    )


def confidence(supporting: Column, dates: Column) -> Column:
    """0.55, more for up to seven evidences and up to five dates, at most 0.95."""
    return F.least(F.lit(0.95), F.lit(0.55) + 0.07 * F.least(supporting - 3, F.lit(4)) + 0.10 * F.least(dates - 2, F.lit(3)))


def mine(cards: DataFrame, existing: DataFrame | None = None, *, since: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates: ``description``, ``supporting_evidence``, ``contexts``, ``confidence``, ``n_observations``, ``n_dates``.

    Counts are aggregates over all observations; only the first ``max_supporting`` of a context are put into its evidence.
    They are ranked within (context, month) first, so that a context of every day isn't sorted in one task.
    """
    seen = observations(cards)
    if since is not None:
        seen = seen.where(F.col("period") >= since)
    totals = seen.groupBy("context").agg(F.count("*").alias("n_observations"), F.countDistinct("period").alias("n_dates"))
    n = settings.max_supporting
    monthly = Window.partitionBy("context", F.substring("period", 1, 7)).orderBy("ord")
    few = seen.withColumn("_r", F.row_number().over(monthly)).where(F.col("_r") <= n)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("context").orderBy("ord"))).where(F.col("_r") <= n)
    evidence = F.struct(F.to_date("period").alias("source_date"), "summary", "source_id")
    listed = few.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("_r", evidence.alias("e")))).alias("l"))
    rows = totals.where((F.col("n_observations") >= settings.min_observations) & (F.col("n_dates") >= settings.min_dates)).join(listed, "context")
    rows = rows.withColumn("supporting_evidence", F.transform("l", lambda x: x["e"])).where(F.size("supporting_evidence") >= 3)
    out = rows.select(
        _description(F.col("context")).alias("description"),
        "supporting_evidence",
        F.array(F.lit("t2"), F.substring_index("context", ":", 1)).alias("contexts"),
        F.round(confidence(F.size("supporting_evidence"), F.col("n_dates")), 6).alias("confidence"),
        "n_observations",
        "n_dates",
    )
    if existing is not None:
        known = existing.select(label_key(F.col("description")).alias("_k")).distinct()
        out = out.withColumn("_k", label_key(F.col("description"))).join(known, "_k", "left_anti").drop("_k")
    return out


def ordered(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc(F.size("supporting_evidence")), "description")


def listed(candidates: DataFrame, *, status: str | None = "pending", limit: int = 20) -> DataFrame:
    if status is not None and status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    rows = candidates if status is None else candidates.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def resolve(candidates: DataFrame, decisions: DataFrame, at: dt.datetime | str) -> tuple[DataFrame, DataFrame]:
    """Candidates after decisions (``candidate_id``, ``decision``, ``confirmed_content``, ``note``), and the writes that follow.

    A candidate is decided once, from pending. Confirming or editing writes a reflective memory with the given wording or
    the description; rejecting writes none. Wording given with a confirmation is used, and the status stays confirmed.
    """
    first = decisions.groupBy("candidate_id").agg(F.min_by(F.struct("decision", "confirmed_content", "note"), F.coalesce("decided_at", F.lit("1970-01-01").cast("timestamp"))).alias("d")) if "decided_at" in decisions.columns else decisions.groupBy("candidate_id").agg(F.min(F.struct("decision", "confirmed_content", "note")).alias("d"))
    rows = candidates.join(first, candidates["id"] == first["candidate_id"], "left")
    due = F.col("candidate_id").isNotNull() & (F.col("status") == "pending")
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("confirm", "confirmed", "edit", "edited", "reject", "rejected")]), F.col("d.decision"))
    changed = {"status": F.when(due, status).otherwise(F.col("status")), "resolution_note": F.when(due, F.col("d.note")).otherwise(F.col("resolution_note")), "updated_at": F.when(due, instant(at)).otherwise(F.col("updated_at"))}
    after = rows.select(*[changed.get(c, F.col(c)).alias(c) for c in candidates.columns])
    writes = rows.where(due & F.col("d.decision").isin("confirm", "edit")).select(
        F.col("id").alias("candidate_id"), F.lit("reflective").alias("namespace"), F.lit("confirmed_pattern").alias("category"),
        F.coalesce(F.nullif(F.trim("d.confirmed_content"), F.lit("")), F.col("description")).alias("content"), instant(at).alias("written_at"),
    )
    return after, writes
