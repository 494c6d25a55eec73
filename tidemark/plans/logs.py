"""Queries over the log reader and the life of candidates: logs are written from the delivered turns, then read as logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import patterns
from tidemark.plans import turn
from tidemark.session import shared_dir, tables
from tidemark.sources import lines, nested_log

ROLES = ("user", "assistant")


def log_nested_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered turn as a record of a nested log, in several files, and what the reader makes of them."""
    t = tables(spark, sf, "parsed_turns")
    message = F.struct("role", F.col("text").alias("content"))
    record = F.struct(F.col("role").alias("type"), F.col("delivery_id").cast("string").alias("uuid"), F.col("session_id").alias("sessionId"), nested_log.iso(F.col("created_at")).alias("timestamp"), "cwd", F.col("git_branch").alias("gitBranch"), message.alias("message"))
    folder = f"{shared_dir(spark)}/logs-{sf.strip('/').replace('/', '-')}"
    t.select(F.to_json(record)).repartition(8).write.mode("overwrite").text(folder)
    found, _metrics = nested_log.parse(lines.read_lines(lines.discover(spark, folder, "*.txt")))
    return found.select("source_key", "session_id", "role", F.unix_micros("created_at").alias("created_us"), "project", "git_branch")


def pattern_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Mined candidates, decided by a fixed rule of their number: what becomes of each, and the wording that is kept."""
    mined = turn.pattern_candidates(spark, sf).select("description")
    nulls = {"resolution_note": "string", "confirmed_memory_id": "long", "updated_at": "timestamp"}
    rows = mined.withColumn("id", F.row_number().over(Window.orderBy("description")).cast("long")).withColumn("status", F.lit("pending"))  # a few hundred candidates
    rows = rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in nulls.items()])
    what = F.element_at(F.array(F.lit("confirm"), F.lit("edit"), F.lit("reject")), (F.col("id") % 3 + 1).cast("int"))
    decisions = rows.where("id % 4 != 3").select(F.col("id").alias("candidate_id"), what.alias("decision"), F.when(what == "edit", F.concat(F.lit("kept: "), F.col("description"))).alias("confirmed_content"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("note"))
    after, writes = patterns.resolve(rows, decisions, "2026-04-01 00:00:00")
    return after.join(writes.select(F.col("candidate_id").alias("id"), "content"), "id", "left").select("id", "description", "status", "resolution_note", "content")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (log_nested_turns, pattern_lifecycle)}

ORACLES: dict[str, str] = {
    "log_nested_turns": r"""
        select 'nested-log:' || delivery_id as source_key, coalesce(nullif(session_id, ''), 'unknown') as session_id, role, epoch_us(created_at) as created_us,
               nullif(list_last(string_split(regexp_replace(nullif(cwd, ''), '/+$', ''), '/')), '') as project, nullif(git_branch, '') as git_branch
        from parsed_turns
        where role in ('user', 'assistant') and created_at is not null and not regexp_full_match(coalesce(text, ''), '[\s\p{Z}\x0b\x{85}]*')""",
    "pattern_lifecycle": f"""
        with c as (select description, row_number() over (order by description) as id from ({turn.ORACLES["pattern_candidates"]}))
        select id, description,
               case when id % 4 = 3 then 'pending' when id % 3 = 0 then 'confirmed' when id % 3 = 1 then 'edited' else 'rejected' end as status,
               case when id % 4 <> 3 then 'note ' || id end as resolution_note,
               case when id % 4 = 3 or id % 3 = 2 then null when id % 3 = 0 then description else 'kept: ' || description end as content
        from c""",
}
