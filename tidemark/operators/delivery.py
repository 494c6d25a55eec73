"""Messages delivered at least once: keep exactly one row of each identifier (problem 3).

The first arrival of an identifier is an aggregate, so copies are combined before any shuffle. Rows then meet it by the
identifier. An identifier with very many rows is joined by broadcast instead: there can be no more than
``rows / hot_rows`` of those, which bounds what is sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

HOT_ROWS = 1_000_000


def _order(arrived: str, row_id: str) -> Column:
    """Earliest arrival first, an unknown one last, then the lowest id."""
    return F.struct(F.col(arrived).isNull().alias("late"), F.col(arrived).alias("at"), F.col(row_id).alias("id"))


def _with_first(packed: DataFrame, hot_rows: int) -> DataFrame:
    """``packed`` (identifier ``k``, order ``o``, any ``row``) with ``first``, the order of the row to keep.

    ``first`` is null for identifiers that occur once.
    """
    firsts = packed.where("k is not null").groupBy("k").agg(F.min("o").alias("first"), F.count("*").alias("n"))
    several = cut(firsts.where("n > 1"))
    hot = several.where(F.col("n") >= hot_rows)  # at most rows / hot_rows of them
    usual = several.where(F.col("n") < hot_rows).drop("n")
    keyed = packed.where("k is not null")  # the others would all meet in one task
    alone = packed.where("k is null").withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    if hot.isEmpty():
        return keyed.join(usual, "k", "left").unionByName(alone)
    apart = keyed.join(F.broadcast(hot.drop("n")), "k")
    return keyed.join(F.broadcast(hot.select("k")), "k", "left_anti").join(usual, "k", "left").unionByName(apart).unionByName(alone)


def surplus_rows(rows: DataFrame, key: str, arrived: str, row_id: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ids (``record_id``) of all rows of an identifier but the one that arrived first.

    Ties in time go to the lowest id; rows without an identifier are no copies of each other; a row that repeats the kept
    one in id and time too is the same record and isn't surplus; an empty table gives none. Columns besides the three
    named ones aren't read.
    """
    found = _with_first(rows.select(F.col(key).alias("k"), _order(arrived, row_id).alias("o")), hot_rows)
    return found.where("first is not null and o != first").select(F.col("o.id").cast("long").alias("record_id"))


def first_deliveries(rows: DataFrame, key: str, arrived: str, row_id: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` without the surplus ones, exactly one for each identifier; all their columns stay.

    Of rows that are equal in identifier, time and id, any one is kept.
    """
    packed = rows.select(F.col(key).alias("k"), _order(arrived, row_id).alias("o"), F.struct(*rows.columns).alias("row"))
    found = _with_first(packed, hot_rows)
    kept = found.where("o = first").dropDuplicates(["k"])
    return found.where("first is null").unionByName(kept).select("row.*")


def new_deliveries(batch: DataFrame, stored: DataFrame, key: str, arrived: str, row_id: str, *, stored_key: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first deliveries of a batch whose identifier isn't stored yet; rows without one are new."""
    known = stored.select(F.col(stored_key or key).alias("k")).where("k is not null").distinct()
    once = first_deliveries(batch, key, arrived, row_id, hot_rows=hot_rows)
    packed = once.select(F.col(key).alias("k"), F.struct(*once.columns).alias("row"))
    return packed.join(known, "k", "left_anti").select("row.*")
