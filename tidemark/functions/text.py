"""String functions of the digests, readers and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, WHITE, "")


def label_key(text: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def token_estimate(text: Column) -> Column:
    """At least one token, else one for each three characters begun."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 3)).cast("int")


def base_name(path: Column) -> Column:
    """The last part of a path; null for a null or empty one."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), F.lit(""))


def unfence(text: Column) -> Column:
    """A struct of ``text`` without a surrounding code fence and ``unfenced``, whether there was one."""
    inner = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    fenced = text.rlike(r"(?s)^\s*```(?:json)?\s*.*?\s*```\s*$")
    return F.struct(F.when(fenced, inner).otherwise(text).alias("text"), fenced.alias("unfenced"))


def list_field(fact: Column) -> Column:
    """The items of a fact like ``Name: a, b (+2 more)``."""
    body = F.when(F.instr(fact, ":") > 0, F.regexp_replace(fact, r"(?s)^[^:]*:", "")).otherwise(fact)
    parts = F.transform(F.split(body, ","), lambda x: F.trim(F.regexp_replace(x, r"\(\+\d+\s+more\)", "")))
    return F.filter(parts, lambda x: x != "")


def session_from_stem(path: Column) -> Column:
    """The id in a rollout file's name, or the name without its ending."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    found = F.regexp_extract(stem, r"^rollout-\d{4}-\d{2}-\d{2}T[\d-]+-([0-9a-f-]{36})$", 1)
    return F.when(found != "", found).otherwise(stem)


def one_line(text: Column, most: int = 400) -> Column:
    """Stripped, on one line, cut after ``most`` characters with an ellipsis."""
    flat = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)
