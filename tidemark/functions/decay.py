"""Exponential time decay of memories, always relative to an explicit instant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: dt.datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def age_days(created_at: Column, as_of: Column) -> Column:
    """Days between; negative for rows from the future."""
    return (F.unix_micros(as_of) - F.unix_micros(created_at)) / F.lit(86_400e6)


def multiplier(age: Column, decay_factor: Column, valid_at: Column, *, per_day: float, closed_penalty: float) -> Column:
    """``exp(-per_day * factor * age)``, times the penalty for a closed memory."""
    return F.exp(F.lit(-per_day) * decay_factor.cast("double") * age) * F.when(valid_at.isNull(), F.lit(1.0)).otherwise(F.lit(closed_penalty))
