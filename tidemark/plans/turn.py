"""Queries over turns, digests, cards, patterns and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timez import local_date
from tidemark.operators import cards, digest, extraction, patterns, review, turns
from tidemark.session import tables

ZONE = "America/New_York"
START, END = "2026-01-15 00:00:00", "2026-02-01 00:00:00"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "session_turns")


def turn_session_window(spark: SparkSession, sf: str) -> DataFrame:
    return turns.session_window(_turns(spark, sf)).select("session_id", "position", "id")


def turn_evicted(spark: SparkSession, sf: str) -> DataFrame:
    return turns.evicted(_turns(spark, sf)).select("session_id", "id")


def turn_buffer_stats(spark: SparkSession, sf: str) -> DataFrame:
    return turns.buffer_stats(_turns(spark, sf))


def turn_range(spark: SparkSession, sf: str) -> DataFrame:
    return turns.between(_turns(spark, sf), START, END, 200).select("id", "role", F.unix_micros("created_at").alias("created_us"))


def turn_range_count(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).where(turns.in_range(START, END)).agg(F.count("*").alias("turns"))


def turn_roles(spark: SparkSession, sf: str) -> DataFrame:
    return turns.known_roles(_turns(spark, sf)).groupBy("role").agg(F.count("*").alias("turns"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def turn_keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    stored = _turns(spark, sf)
    batch = tables(spark, sf, "ingest_rows").withColumnRenamed("row_id", "_row")
    batch = batch.select("session_id", "role", "content", "tool", "token_count", "created_at", "source_key", "project", "git_branch", "tool_names", "_row")
    after, _new = turns.upsert(stored, batch, order="_row")
    return after.select("source_key", "project", "git_branch", F.size("tool_names").alias("n_tools"), (F.col("id") > stored.agg(F.max("id")).first()[0]).alias("is_new"))


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).where("created_at is not null").withColumn("period", local_date(F.col("created_at"), ZONE).cast("string"))


def day_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = digest.stats(_dated(spark, sf), ["period"], ZONE)
    return rows.select("period", "sessions", "turns", "user_turns", "assistant_turns", "tokens", F.unix_micros("first_activity").alias("first_us"), F.unix_micros("last_activity").alias("last_us"), F.unix_micros("latest_late").alias("late_us"), F.array_join("branches", "|").alias("branches"), F.array_join("sources", "|").alias("sources"))


def _flat(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("period", F.posexplode(name).alias("place", "x")).select("period", "place", F.col("x.name").alias("name"), F.col("x.count").alias("n"))


def day_tool_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(digest.tool_counts(_dated(spark, sf), ["period"]), "tools")


def day_project_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(digest.project_counts(_dated(spark, sf), ["period"]), "projects")


def day_cards(spark: SparkSession, sf: str) -> DataFrame:
    return digest.day_cards(_turns(spark, sf), ZONE).select("period", "summary", F.array_join("facts", "\n").alias("facts"))


def session_cards(spark: SparkSession, sf: str) -> DataFrame:
    return digest.session_cards(_turns(spark, sf), ZONE).select("period", "session_id", "summary", F.array_join("facts", "\n").alias("facts"))


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    """Day and session cards as a stored tier."""
    t = _turns(spark, sf)
    day = digest.day_cards(t, ZONE).select("period", F.lit(None).cast("string").alias("session_id"), "summary", "facts")
    one = digest.session_cards(t, ZONE).select("period", "session_id", "summary", "facts")
    rows = day.unionByName(one).withColumnRenamed("facts", "developer_behavior_facts")
    key = F.xxhash64("period", F.coalesce("session_id", F.lit("")))
    return rows.select(key.alias("id"), "*", F.lit(None).cast("string").alias("narrative"), F.lit("rule").alias("generated_by"))


def card_list_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return cards.listed(_cards(spark, sf), scope="all", limit=365).select("period", "session_id", "summary")


def card_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return _cards(spark, sf).select("period", "session_id", cards.token_count(F.col("summary"), F.col("developer_behavior_facts")).alias("token_count"))


def pattern_candidates(spark: SparkSession, sf: str) -> DataFrame:
    mined = patterns.mine(_cards(spark, sf).where("session_id is null").withColumn("id", F.lit(1).cast("long")))
    first = F.element_at("supporting_evidence", 1)
    return mined.select("description", F.size("supporting_evidence").alias("n_supporting"), "n_observations", "n_dates", "confidence", first["source_date"].cast("string").alias("first_date"), first["summary"].alias("first_summary"), first["source_id"].alias("first_source"))


def daily_review(spark: SparkSession, sf: str) -> DataFrame:
    memories = tables(spark, sf, "memory_vectors")
    pending = patterns.mine(_cards(spark, sf).where("session_id is null")).select(F.xxhash64("description").alias("id"), "description", F.lit("pending").alias("status"), F.lit("2026-04-01").cast("timestamp").alias("created_at"))
    row = review.daily_review(_cards(spark, sf), memories, pending, today="2026-04-01")
    return row.select("period", F.col("card.summary").alias("summary"), F.coalesce(F.size("operational"), F.lit(0)).alias("n_operational"), F.coalesce(F.size("reflective"), F.lit(0)).alias("n_reflective"), F.size("pending").alias("n_pending"))


def banner(spark: SparkSession, sf: str) -> DataFrame:
    results = tables(spark, sf, "extraction_results")
    told = results.select(F.when(F.col("ok"), F.lit("told")).alias("narrative"), F.coalesce("provider", F.lit("rule")).alias("generated_by"))
    return review.banner(told, tables(spark, sf, "memory_vectors"))


def prompt_packing(spark: SparkSession, sf: str) -> DataFrame:
    t = turns.known_roles(_dated(spark, sf).where("session_id is not null"))
    keys = ["period", "session_id"]
    facts = digest.session_cards(_turns(spark, sf), ZONE, min_turns=1).select(*keys, "facts")
    packed = extraction.pack_prompts(t, facts, keys, system_tokens=150, max_input_tokens=1000)
    return packed.groupBy(*keys, "kind").agg(F.count("*").alias("kept"), F.sum("cost").alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (turn_session_window, turn_evicted, turn_buffer_stats, turn_range, turn_range_count, turn_roles, turn_keyed_upsert, day_stats, day_tool_counts, day_project_counts, day_cards, session_cards, card_list_scoped, card_token_count, pattern_candidates, daily_review, banner, prompt_packing)
}

_L = f"(created_at at time zone '{ZONE}')"
_D = f"{_L}::date::varchar"
_BASE = f"select *, {_D} as period from session_turns where created_at is not null"
_TOKENS = "greatest(1, ceil(length({0}) / 3.0))::int"


def _digest_sql(keys: str, more: str = "true") -> str:
    """Statistics and facts of each group, as common table expressions that end in ``f``."""
    k = keys.split(", ")
    on = " and ".join(f"a.{x} = b.{x}" for x in k)
    return f"""
    b as ({_BASE} and {more}),
    s as (select {keys}, count(distinct session_id) as sessions, count(*) as turns, count(*) filter (role = 'user') as user_turns,
                 count(*) filter (role = 'assistant') as assistant_turns, coalesce(sum(token_count), 0)::bigint as tokens,
                 min(created_at) as first_at, max(created_at) as last_at, max(created_at) filter (hour({_L}) <= 5) as late_at,
                 list_sort(list(distinct git_branch) filter (git_branch <> '')) as branches, list_sort(list(distinct tool) filter (tool is not null)) as sources
          from b group by {keys}),
    te as (select {keys}, created_at, id, i - 1 as pos, tool_names[i] as name from (select *, unnest(range(1, len(tool_names) + 1)) as i from b)),
    tc as (select {keys}, name, count(*) as n, min((created_at, id, pos)) as first from te group by {keys}, name),
    tl as (select {keys}, list({{'name': name, 'n': n}} order by n desc, first) as tools from tc group by {keys}),
    pc as (select {keys}, project as name, count(*) as n, min((created_at, id)) as first from b where project is not null and project <> '' group by {keys}, project),
    pl as (select {keys}, list({{'name': name, 'n': n}} order by n desc, first) as projects from pc group by {keys}),
    j as (select a.*, coalesce(tools, []) as tools, coalesce(projects, []) as projects,
                 (floor(epoch_us((last_at at time zone '{ZONE}')::timestamp - (first_at at time zone '{ZONE}')::timestamp) / 60000000.0))::bigint as mins
          from s a left join tl b on {on} left join (select * from pl) c on {" and ".join(f"a.{x} = c.{x}" for x in k)}),
    f as (select *,
      case when len(projects) > 0 then projects[1].name else 'unknown project' end as lead,
      case when len(tools) > 0 then ', mostly ' || tools[1].name else '' end as mostly,
      strftime(first_at at time zone '{ZONE}', '%H:%M') as t0, strftime(last_at at time zone '{ZONE}', '%H:%M') as t1,
      array_to_string(list_filter([
        case when len(projects) > 0 then 'Projects touched: ' || array_to_string(list_transform(projects[1:3], lambda x: x.name), ', ') ||
             case when len(projects) > 3 then ' (+' || (len(projects) - 3) || ' more)' else '' end end,
        case when len(tools) > 0 then 'Tool calls: ' || array_to_string(list_transform(tools[1:5], lambda x: x.name || ' ×' || x.n), ', ') end,
        'Active ' || strftime(first_at at time zone '{ZONE}', '%H:%M') || '–' || strftime(last_at at time zone '{ZONE}', '%H:%M') || ' local (' || (mins // 60) || 'h' || lpad((mins % 60)::varchar, 2, '0') || 'm span)',
        case when late_at is not null then 'Worked past midnight — latest small-hours turn at ' || strftime(late_at at time zone '{ZONE}', '%H:%M') || ' local (an observation, not a claim about how you felt)' end,
        sessions || ' session(s), ' || turns || ' turns (' || user_turns || ' from you), ~' || tokens || ' tokens',
        case when len(coalesce(branches, [])) > 0 then 'Git branches: ' || array_to_string(branches[1:5], ', ') end,
        'Sources: ' || array_to_string(coalesce(sources, []), ', ')], lambda x: x is not null), chr(10)) as facts
      from j)"""


_DAY = _digest_sql("period")
_SESSION = _digest_sql("period, session_id", "session_id is not null")
_DAY_SUMMARY = "turns || ' turns across ' || sessions || ' session(s), led by ' || lead || mostly || '.'"
_SESSION_SUMMARY = "'session ' || substr(string_split(session_id, ':')[-1], 1, 8) || ' — ' || turns || ' turns in ' || lead || ' from ' || t0 || mostly || '.'"
_CARDS = f"""
    with d as (with {_DAY} select period, null::varchar as session_id, {_DAY_SUMMARY} as summary, facts from f),
    e as (with {_SESSION} select period, session_id, {_SESSION_SUMMARY} as summary, facts from f where turns >= 6),
    cards as (select * from d union all select * from e)"""
_LABEL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_MINED = f"""
    facts as (select period, i - 1 as idx, string_split(facts, chr(10))[i] as fact from (select *, unnest(range(1, len(string_split(facts, chr(10))) + 1)) as i from cards where session_id is null)),
    items as (
      select period, idx, fact, p - 1 as pos, trim(regexp_replace(l[p], '\\(\\+\\d+\\s+more\\)', '', 'g')) as item
      from (select *, unnest(range(1, len(l) + 1)) as p from (select *, string_split(regexp_replace(fact, '^[^:]*:', ''), ',') as l from facts
            where starts_with(fact, 'Projects touched:') or starts_with(fact, 'Git branches:') or starts_with(fact, 'Sources:') or starts_with(fact, 'Tool calls:')))),
    ev as (
      select period, idx, pos, 'project' as kind, {_LABEL.format('item')} as label, 'Project seen on ' || period || ': ' || item as summary from items where starts_with(fact, 'Projects') and item <> ''
      union all select period, idx, pos, 'git_branch', {_LABEL.format('item')}, 'Git branch seen on ' || period || ': ' || item from items where starts_with(fact, 'Git') and item <> ''
      union all select period, idx, pos, 'source', {_LABEL.format('item')}, 'Source seen on ' || period || ': ' || item from items where starts_with(fact, 'Sources') and item <> ''
      union all select period, idx, pos, 'tool', {_LABEL.format("regexp_extract(item, '^([^×]+)×', 1)")}, 'Tool usage on ' || period || ': ' || trim(regexp_extract(item, '^([^×]+)×', 1)) || ' ×' || regexp_extract(item, '×(\\d+)', 1) from items where starts_with(fact, 'Tool')
      union all select period, idx, 0, 'pattern', 'late_hours', 'Observed past-midnight work on ' || period from facts where contains(fact, 'Worked past midnight')),
    ranked as (select *, row_number() over (partition by kind, label order by period, idx, pos) as k, count(*) over (partition by kind, label) as n from ev where label <> ''),
    mined as (
      select kind, label, max(n) as n_observations, count(distinct period) as n_dates, least(max(n), 10) as n_supporting,
             max(case when k = 1 then period end) as first_date, max(case when k = 1 then summary end) as first_summary, max(case when k = 1 then 't2:1:' || idx end) as first_source
      from ranked group by kind, label having max(n) >= 3 and count(distinct period) >= 2)"""

ORACLES = {
    "turn_session_window": """
        with r as (select *, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as k from session_turns),
        w as (select * from r where k <= 12)
        select session_id, (max(k) over (partition by session_id) - k + 1)::int as position, id from w""",
    "turn_evicted": "select session_id, id from (select *, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as k from session_turns) where k > 12",
    "turn_buffer_stats": """
        with r as (select *, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as k from session_turns)
        select session_id, count(*) filter (k <= 12) as turns, coalesce(sum(token_count) filter (k <= 12), 0)::bigint as tokens, greatest(0, count(*) - 12) as evicted from r group by session_id""",
    "turn_range": f"select id, role, epoch_us(created_at) as created_us from session_turns where created_at >= timestamptz '{START}+00' and created_at < timestamptz '{END}+00' order by created_at, id limit 200",
    "turn_range_count": f"select count(*) as turns from session_turns where created_at >= timestamptz '{START}+00' and created_at < timestamptz '{END}+00'",
    "turn_roles": "select lower(trim(role)) as role, count(*) as turns, coalesce(sum(token_count), 0)::bigint as tokens from session_turns where lower(trim(role)) in ('user', 'assistant', 'tool') group by 1",
    "turn_keyed_upsert": """
        with b as (select * from ingest_rows qualify source_key is null or row_number() over (partition by source_key order by row_id) = 1)
        select s.source_key, coalesce(b.project, s.project) as project, coalesce(b.git_branch, s.git_branch) as git_branch,
               case when coalesce(len(s.tool_names), 0) = 0 and b.tool_names is not null then len(b.tool_names) else len(s.tool_names) end::int as n_tools, false as is_new
        from session_turns s left join b on s.source_key = b.source_key
        union all
        select source_key, project, git_branch, len(tool_names)::int, true from b
        where source_key is null or source_key not in (select source_key from session_turns where source_key is not null)""",
    "day_stats": f"""
        with {_DAY} select period, sessions, turns, user_turns, assistant_turns, tokens, epoch_us(first_at) as first_us, epoch_us(last_at) as last_us, epoch_us(late_at) as late_us,
        array_to_string(coalesce(branches, []), '|') as branches, array_to_string(coalesce(sources, []), '|') as sources from f""",
    "day_tool_counts": f"with {_DAY} select period, (i - 1)::int as place, tools[i].name as name, tools[i].n as n from (select *, unnest(range(1, len(tools) + 1)) as i from j)",
    "day_project_counts": f"with {_DAY} select period, (i - 1)::int as place, projects[i].name as name, projects[i].n as n from (select *, unnest(range(1, len(projects) + 1)) as i from j)",
    "day_cards": f"with {_DAY} select period, {_DAY_SUMMARY} as summary, facts from f",
    "session_cards": f"with {_SESSION} select period, session_id, {_SESSION_SUMMARY} as summary, facts from f where turns >= 6",
    "card_list_scoped": f"{_CARDS} select period, session_id, summary from cards order by period desc, session_id asc nulls first limit 365",
    "card_token_count": f"{_CARDS} select period, session_id, ({_TOKENS.format('summary')} + list_sum(list_transform(string_split(facts, chr(10)), lambda x: {_TOKENS.format('x')})))::int as token_count from cards",
    "pattern_candidates": f"""{_CARDS}, {_MINED}
        select case kind when 'project' then 'Repeated project work tied to ' || label || '.' when 'tool' then 'Frequent tool preference around ' || label || '.'
                 when 'git_branch' then 'Recurring branch context: ' || label || '.' else 'Observed repeated signal: ' || replace(kind || ':' || label, '_', ' ') || ' over time.' end as description,
               n_supporting::int as n_supporting, n_observations, n_dates,
               round(least(0.95, 0.55 + 0.07 * least(n_supporting - 3, 4) + 0.10 * least(n_dates - 2, 3))::double, 6) as confidence, first_date, first_summary, first_source
        from mined""",
    "daily_review": f"""{_CARDS}, {_MINED},
        p as (select max(period) as period from cards where session_id is null),
        m as (select *, row_number() over (partition by namespace order by created_at desc, id desc) as k from memory_vectors where valid_at is null)
        select p.period, (select summary from cards c where c.period = p.period and session_id is null) as summary,
          (select count(*) from m where k <= 200 and namespace = 'operational' and (created_at at time zone 'UTC')::date::varchar = p.period)::int as n_operational,
          (select count(*) from m where k <= 200 and namespace = 'reflective' and (created_at at time zone 'UTC')::date::varchar = p.period)::int as n_reflective,
          (select least(count(*), 100) from mined)::int as n_pending
        from p""",
    "banner": "select (select count(*) from memory_vectors where valid_at is null) as open_memories, (select count(*) from extraction_results where ok and coalesce(provider, 'rule') <> 'rule') as narrated_cards",
    "prompt_packing": rf"""
        with sf as (with {_SESSION} select period, session_id, facts from f),
        t as (select *, lower(trim(role)) as r, {_D} as period from session_turns where created_at is not null and session_id is not null and lower(trim(role)) in ('user', 'assistant', 'tool')),
        x as (select period, session_id, created_at, id, case when r = 'user' then 'user' else 'assistant' end as kind,
                     replace(regexp_replace(content, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), chr(10), ' ') as flat from t),
        y as (select *, case when length(flat) > 400 then substr(flat, 1, 400) || '…' else flat end as text from x where flat <> ''),
        z as (select *, {_TOKENS.format('text')} + 4 as cost from y where kind = 'user' or not regexp_full_match(text, '(\[tool:[^\]]+\]\s*)+')),
        q as (select *, row_number() over (partition by period, session_id, kind order by created_at, id) - 1 as pos, count(*) filter (kind = 'assistant') over (partition by period, session_id) as na from z),
        g as (select q.*, 1000 - 150 - 200 - {_TOKENS.format('facts')} as budget from q join sf using (period, session_id)),
        h as (select *, case when na > 0 then trunc(budget * 0.35)::int else 0 end as reserve from g),
        u as (select *, sum(cost) over (partition by period, session_id order by pos rows unbounded preceding) as s from h where kind = 'user'),
        uk as (select * from u where s <= budget - reserve),
        sp as (select period, session_id, sum(cost) as spent from uk group by 1, 2),
        a as (select h.*, budget - coalesce(spent, 0) as room from h left join sp using (period, session_id) where kind = 'assistant' and pos % greatest(1, na // 40) = 0),
        ak as (select * from (select *, sum(cost) over (partition by period, session_id order by pos rows unbounded preceding) as s from a) where s <= room and room > 0)
        select period, session_id, kind, count(*) as kept, sum(cost)::bigint as cost from (select period, session_id, kind, cost from uk union all select period, session_id, kind, cost from ak) group by 1, 2, 3""",
}
