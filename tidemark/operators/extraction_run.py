"""One run of extractions: cards without a narrative become prompts, replies become drafts, drafts become narratives and preferences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions.text import token_estimate
from tidemark.functions.timez import local_date
from tidemark.operators import cards as card_ops
from tidemark.operators.extraction import Provider, ask, is_object, pack_prompts, render, validated
from tidemark.session import cut

KEYS = ["period", "session_key"]


@dataclass(frozen=True)
class Run:
    """``attempts`` and ``pairs`` in the form of the captured logs, ``updates`` for the cards, ``preferences`` to write."""

    attempts: DataFrame
    pairs: DataFrame
    updates: DataFrame
    preferences: DataFrame


def prompts_of(cards: DataFrame, turns: DataFrame, system: str, tz: str, *, max_input_tokens: int) -> DataFrame:
    """``period``, ``session_id``, ``id``, ``system``, ``user``: a prompt for each card, from the turns of its day or of its session on that day."""
    wanted = cards.select("id", "period", "session_id", F.coalesce("session_id", F.lit("")).alias("session_key"), F.col("developer_behavior_facts").alias("facts"))
    dated = turns.where("created_at is not null").withColumn("period", local_date(F.col("created_at"), tz).cast("string")).select("period", "session_id", "id", "role", "content", "created_at")
    dated = dated.join(F.broadcast(wanted.select("period").distinct()), "period", "left_semi")  # at most 365 cards are listed
    day = dated.join(F.broadcast(wanted.where("session_id is null").select("period", "session_key")), "period")
    one = dated.withColumn("session_key", F.col("session_id")).join(F.broadcast(wanted.where("session_id is not null").select(*KEYS)), KEYS)
    rows = day.select(*KEYS, "id", "role", "content", "created_at").unionByName(one.select(*KEYS, "id", "role", "content", "created_at"))
    facts = wanted.select(*KEYS, "facts")
    # An estimate of tokens is three characters each, as everywhere.
    packed = pack_prompts(rows, facts, KEYS, system_tokens=-(-len(system) // 3), max_input_tokens=max_input_tokens)
    return render(packed, facts, KEYS).join(wanted.select("id", "session_id", *KEYS), KEYS).select("id", "period", "session_id", F.lit(system).alias("system"), F.concat(F.lit("DATE: "), F.col("period"), F.lit("\n\n"), F.col("prompt")).alias("user"))


def run(
    cards: DataFrame, turns: DataFrame, make_provider: Callable[[], Provider], at: Column, *, system: str, provider: str, model: str, prompt_version: str = "v1", tz: str = DEFAULTS.timezone,
    max_attempts: int = 3, max_input_tokens: int = 12_000, min_confidence: float = DEFAULTS.min_confidence, check: Callable[[str], str | None] = is_object,
) -> Run:
    """Asks for every given card and sorts the replies; only a valid draft makes a pair, a narrative or a preference."""
    prompts = cut(prompts_of(cards, turns, system, tz, max_input_tokens=max_input_tokens))
    replies = validated(cut(ask(prompts, make_provider, check, max_attempts=max_attempts)))
    fault = F.when(~F.col("valid"), F.array_join("violations", "\n"))
    spent = replies.join(prompts.select("id", "system", "user"), "id")
    one = F.struct(
        F.col("attempt_index").alias("index"), "raw", F.col("valid").alias("ok"), fault.alias("errors"), "unfenced",
        (token_estimate(F.col("system")) + token_estimate(F.col("user"))).alias("input_tokens"), token_estimate(F.col("raw")).alias("output_tokens"),
    )
    # At most ``max_attempts`` of each prompt are gathered; the first valid one is the last that was made.
    grouped = spent.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("attempts"), F.max("valid").alias("ok"), F.max(F.col("valid") & (F.col("attempt_index") == 1)).alias("first_attempt_valid"), F.max_by("draft", F.when(F.col("valid"), -F.col("attempt_index"))).alias("completion"))
    rows = cut(prompts.join(grouped, "id").withColumns({"date": F.col("period"), "provider": F.lit(provider), "model": F.lit(model), "prompt_version": F.lit(prompt_version), "extracted_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")}))
    attempts = rows.select("date", "session_id", "provider", "model", "prompt_version", "ok", "first_attempt_valid", "extracted_at", "attempts")
    good = rows.where("ok")
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("content")) for r, c in (("system", "system"), ("user", "user"))])
    meta = F.struct("provider", "model", F.size("attempts").alias("attempts"), "first_attempt_valid", "extracted_at")
    pairs = good.select("date", "session_id", messages.alias("messages"), "completion", meta.alias("meta"))
    updates = good.select("period", "session_id", "completion.narrative", "completion.highlights", "completion.open_threads", F.concat_ws(":", "provider", "model").alias("generated_by"), "model", at.alias("extracted_at"))
    prefs = good.select("date", F.explode("completion.preferences").alias("p")).where(F.col("p.confidence") >= min_confidence).select("date", F.lit("operational").alias("namespace"), "p.category", "p.content")
    return Run(attempts, pairs, updates, prefs)


def due(cards: DataFrame, *, scope: str = "day", limit: int = 3) -> DataFrame:
    """The newest cards of a scope that nobody has narrated yet."""
    return card_ops.missing_narrative(cards if scope == "all" else cards.where(F.col("session_id").isNull() if scope == "day" else F.col("session_id").isNotNull()), limit)
