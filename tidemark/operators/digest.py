"""Day and session digests of turns: counts, ordered lists and the sentences made of them.

Lists ordered by frequency break ties by first appearance, which is the least (time, id, place in the list). Everything
is aggregated by (group, item) before a group's list is put together, so what is gathered is one entry for each distinct
tool, project or branch of a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timez import local, local_date, span_minutes

LATE_UNTIL = 5


def _ranked(rows: DataFrame, keys: list[str], item: str, name: str) -> DataFrame:
    """For each group an array of (item, count), the most frequent first, ties by first appearance."""
    counted = rows.groupBy(*keys, item).agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id", "pos")).alias("first"))
    entry = F.struct((-F.col("n")).alias("o"), F.col("first").alias("f"), F.col(item).alias("name"), F.col("n").alias("count"))
    listed = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select(*keys, F.transform("l", lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count"))).alias(name))


def tool_counts(turns: DataFrame, keys: list[str]) -> DataFrame:
    rows = turns.select(*keys, "created_at", "id", F.posexplode("tool_names").alias("pos", "tool_name"))
    return _ranked(rows, keys, "tool_name", "tools")


def project_counts(turns: DataFrame, keys: list[str]) -> DataFrame:
    rows = turns.where(F.col("project").isNotNull() & (F.col("project") != "")).select(*keys, "created_at", "id", F.lit(0).alias("pos"), "project")
    return _ranked(rows, keys, "project", "projects")


def stats(turns: DataFrame, keys: list[str], tz: str, source: str = "tool") -> DataFrame:
    """One row for each group: counts, first and last activity, latest turn of the small hours, tools, projects, branches, sources."""
    hour = F.hour(local(F.col("created_at"), tz))
    branch = F.when(F.col("git_branch") != "", F.col("git_branch"))
    base = turns.groupBy(*keys).agg(
        F.countDistinct("session_id").alias("sessions"),
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"),
        F.min("created_at").alias("first_activity"),
        F.max("created_at").alias("last_activity"),
        F.max(F.when(hour <= LATE_UNTIL, F.col("created_at"))).alias("latest_late"),
        F.array_sort(F.collect_set(branch)).alias("branches"),
        F.array_sort(F.collect_set(source)).alias("sources"),
    )
    out = base
    for part in (tool_counts(turns, keys), project_counts(turns, keys)):
        out = out.join(part, keys, "left")
    empty = F.array().cast("array<struct<name:string,count:bigint>>")
    return out.withColumn("tools", F.coalesce("tools", empty)).withColumn("projects", F.coalesce("projects", empty))


def _clock(ts: Column, tz: str) -> Column:
    return F.date_format(local(ts, tz), "HH:mm")


def facts(tz: str) -> Column:
    """The sentences of a digest in their fixed order, from the columns of :func:`stats`."""
    c = F.col
    names = F.transform(c("projects"), lambda p: p["name"])
    more = F.when(F.size(names) > 3, F.format_string(" (+%d more)", F.size(names) - 3)).otherwise("")
    tools = F.array_join(F.transform(F.slice("tools", 1, 5), lambda t: F.concat(t["name"], F.lit(" ×"), t["count"].cast("string"))), ", ")
    minutes = span_minutes(c("first_activity"), c("last_activity"), tz)
    active = F.format_string("Active %s–%s local (%dh%02dm span)", _clock(c("first_activity"), tz), _clock(c("last_activity"), tz), F.floor(minutes / 60).cast("int"), minutes % 60)
    late = F.format_string("Worked past midnight — latest small-hours turn at %s local (an observation, not a claim about how you felt)", _clock(c("latest_late"), tz))
    return F.array_compact(
        F.array(
            F.when(F.size(names) > 0, F.concat(F.lit("Projects touched: "), F.array_join(F.slice(names, 1, 3), ", "), more)),
            F.when(F.size("tools") > 0, F.concat(F.lit("Tool calls: "), tools)),
            F.when(c("first_activity").isNotNull(), active),
            F.when(c("latest_late").isNotNull(), late),
            F.format_string("%d session(s), %d turns (%d from you), ~%d tokens", "sessions", "turns", "user_turns", "tokens"),
            F.when(F.size("branches") > 0, F.concat(F.lit("Git branches: "), F.array_join(F.slice("branches", 1, 5), ", "))),
            F.concat(F.lit("Sources: "), F.array_join("sources", ", ")),
        )
    )


def _lead() -> tuple[Column, Column]:
    project = F.when(F.size("projects") > 0, F.element_at("projects", 1)["name"]).otherwise("unknown project")
    tool = F.when(F.size("tools") > 0, F.concat(F.lit(", mostly "), F.element_at("tools", 1)["name"])).otherwise("")
    return project, tool


def day_cards(turns: DataFrame, tz: str) -> DataFrame:
    """``period``, ``summary``, ``facts`` for each local calendar day, beside the statistics."""
    rows = stats(turns.where("created_at is not null").withColumn("period", local_date(F.col("created_at"), tz).cast("string")), ["period"], tz)
    project, tool = _lead()
    headline = F.format_string("%d turns across %d session(s), led by %s%s.", F.col("turns"), F.col("sessions"), project, tool)
    return rows.withColumn("summary", headline).withColumn("facts", facts(tz))


def empty_card(period: Column) -> Column:
    """The card of a day without turns."""
    return F.struct(period.alias("period"), F.lit("No agent activity recorded.").alias("summary"), F.array(F.lit("0 session(s), 0 turns (0 from you), ~0 tokens"), F.lit("Sources: ")).alias("facts"))


def session_cards(turns: DataFrame, tz: str, min_turns: int = 6) -> DataFrame:
    """A card for each session of a day that has enough turns, with its own headline."""
    keys = ["period", "session_id"]
    dated = turns.where("created_at is not null and session_id is not null").withColumn("period", local_date(F.col("created_at"), tz).cast("string"))
    rows = stats(dated, keys, tz).where(F.col("turns") >= min_turns)
    project, tool = _lead()
    short = F.substring(F.element_at(F.split("session_id", ":"), -1), 1, 8)
    headline = F.format_string("session %s — %d turns in %s from %s%s.", short, F.col("turns"), project, _clock(F.col("first_activity"), tz), tool)
    return rows.withColumn("summary", headline).withColumn("facts", facts(tz))


def touched_turns(turns: DataFrame, periods: DataFrame, tz: str) -> DataFrame:
    """The turns of the given local days."""
    dated = turns.where("created_at is not null").withColumn("_p", local_date(F.col("created_at"), tz).cast("string"))
    wanted = periods.select(F.col("period").alias("_p")).distinct()
    return dated.join(wanted, "_p", "left_semi").drop("_p")


def rebuild(turns: DataFrame, periods: DataFrame, tz: str) -> DataFrame:
    """``period``, ``summary``, ``facts`` of the given days from the whole store, also of days without turns."""
    wanted = periods.select("period").distinct()
    built = day_cards(touched_turns(turns, periods, tz), tz).select("period", "summary", "facts")
    blank = wanted.join(built, "period", "left_anti").select(empty_card(F.col("period")).alias("c")).select("c.*")
    return built.unionByName(blank)


def written_cards(turns: DataFrame, periods: DataFrame, tz: str, at: Column, *, days: bool = True, sessions: bool = True, min_turns: int = 6) -> DataFrame:
    """The cards of the given days and of their sessions, as rows that :func:`tidemark.operators.cards.upsert` takes."""
    parts = []
    if days:
        parts.append(rebuild(turns, periods, tz).select(F.lit(None).cast("string").alias("session_id"), "period", "summary", "facts"))
    if sessions:
        parts.append(session_cards(touched_turns(turns, periods, tz), tz, min_turns).select("session_id", "period", "summary", "facts"))
    built = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return built.withColumnRenamed("facts", "developer_behavior_facts").withColumns({"created_at": at, "updated_at": at})
