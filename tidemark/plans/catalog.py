"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import deliveries, logs, memory, text, turn

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for module in (memory, turn, text, deliveries, logs):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
