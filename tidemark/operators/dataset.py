"""Captured prompt and completion pairs: last of each key, stable split, chat form, replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions.hashing import prompt_digest, stable_position
from tidemark.operators.cards import narrate

MARKER = "TRANSCRIPT"
ELLIPSIS = "\n…\n"


def last_pairs(pairs: DataFrame, order: Column) -> DataFrame:
    """The last pair of each (date, session); pairs without a session are told apart by a digest of their last message."""
    prompt = F.coalesce(F.when(F.size("messages") > 0, F.element_at("messages", -1)["content"]), F.lit(""))
    keyed = pairs.withColumn("_k", F.coalesce("session_id", prompt_digest(prompt))).withColumn("_o", order)
    one = keyed.groupBy("date", "_k").agg(F.max_by(F.struct(*[c for c in pairs.columns if c != "date"]), "_o").alias("r"))
    return one.select("date", "r.*").select(*pairs.columns)


def date_positions(rows: DataFrame, date: str = "date") -> DataFrame:
    """``date`` and its stable ``position`` between 0 and 1."""
    return rows.select(F.col(date).alias("date")).distinct().withColumn("position", stable_position(F.col("date")))


def split(pairs: DataFrame, holdout: float = 0.2) -> DataFrame:
    """``pairs`` with ``part``: all pairs of a date are on one side."""
    where = date_positions(pairs).withColumn("part", F.when(F.col("position") < holdout, "holdout").otherwise("train")).drop("position")
    return pairs.join(where, "date")


def report(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("pairs"), F.countDistinct("date").alias("dates"), F.round(F.count_if("meta.first_attempt_valid") / F.count("*"), 4).alias("first_pass"))


def chat_rows(pairs: DataFrame) -> DataFrame:
    """``messages`` with the completion as the assistant's last word, the chat form for training."""
    answer = F.array(F.struct(F.lit("assistant").alias("role"), F.to_json("completion").alias("content")))
    return pairs.select(F.concat("messages", answer).alias("messages"))


def middle_out(text: Column, budget: int, tokens: Callable[[Column], Column] | None = None) -> Column:
    """The text if it fits; else its preamble with the head and the tail of the transcript; null if the preamble alone is too long.

    Without a tokenizer a token is three characters.
    """
    limit = 3 * budget
    at = F.instr(text, MARKER)
    start = F.when(at > 0, at - 1).otherwise(0)
    preamble, body = F.substring(text, F.lit(1), start), F.substring(text, start + 1, F.length(text))
    room = F.lit(limit) - F.length(preamble) - len(ELLIPSIS)
    head = F.floor(room / 2).cast("int")
    cut_ = F.concat(preamble, F.substring(body, F.lit(1), head), F.lit(ELLIPSIS), F.right(body, room - head))
    fits = (tokens(text) <= budget) if tokens else F.length(text) <= limit
    return F.when(fits, text).when(room <= 0, F.lit(None)).otherwise(cut_)


def replay(pairs: DataFrame, cards: DataFrame, order: Column, min_confidence: float = DEFAULTS.min_confidence) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards with the narratives of the last pairs, the pairs whose card is missing, and the preferences to write."""
    last = last_pairs(pairs, order)
    updates = last.select(
        F.col("date").alias("period"), "session_id", "completion.narrative", F.col("completion.highlights").alias("highlights"), "completion.open_threads",
        F.col("meta.provider").alias("generated_by"), "meta.model", F.to_timestamp("meta.extracted_at").alias("extracted_at"),
    )
    keys = cards.select(F.col("period").alias("_p"), F.col("session_id").alias("_s"))
    missing = last.join(keys, (last["date"] == keys["_p"]) & last["session_id"].eqNullSafe(keys["_s"]), "left_anti").select("date", "session_id")
    prefs = last.select("date", F.explode("completion.preferences").alias("p")).where(F.col("p.confidence") >= min_confidence).select("date", F.lit("operational").alias("namespace"), "p.category", "p.content")
    return narrate(cards, updates), missing, prefs
