"""Samples of bounded size that are the same on every run, and that don't grow on the driver with the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 31


def hash_sample(rows: DataFrame, keys: list[str], n: int, *, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, those with the least hash of their keys; all rows if there are no more.

    Rows beyond about ``2 n`` are left out by their hash before anything is ranked. ``total`` is the number of rows, if
    it is known. A sample may be smaller than ``n`` only for want of rows: that fewer than half of the expected rows
    pass the hash doesn't happen in practice.
    """
    count = rows.count() if total is None else total
    place = F.pmod(F.xxhash64(*keys), F.lit(SPACE))
    if count > 2 * n + 1000:
        rows = rows.where(place < int(SPACE * ((2 * n + 1000) / count)))
    return rows.orderBy(place, *keys).limit(n)
