"""Queries over messages that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import delivery
from tidemark.session import tables

DELIVERED = (("parsed_turns", "arrived_at", "delivery_id"), ("ingest_rows", "loaded_at", "row_id"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [delivery.surplus_rows(tables(spark, sf, name), "source_key", at, key).select(F.lit(name).alias("record_table"), "record_id") for name, at, key in DELIVERED]
    return parts[0].unionByName(parts[1])


def p3_kept(spark: SparkSession, sf: str) -> DataFrame:
    parts = [delivery.first_deliveries(tables(spark, sf, name), "source_key", at, key).select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), "source_key", F.unix_micros(F.col(at)).alias("arrived_us")) for name, at, key in DELIVERED]
    return parts[0].unionByName(parts[1])


def p3_new(spark: SparkSession, sf: str) -> DataFrame:
    """First deliveries of parsed turns that the store doesn't have."""
    found = delivery.new_deliveries(tables(spark, sf, "parsed_turns"), tables(spark, sf, "session_turns"), "source_key", "arrived_at", "delivery_id")
    return found.select("delivery_id", "source_key")


QUERIES = {f.__name__: f for f in (p3_found, p3_kept, p3_new)}


def _ranked(table: str, at: str, key: str, keep: str, more: str = "") -> str:
    return f"select '{table}' as record_table, {key} as record_id{more} from (select *, row_number() over (partition by source_key order by {at} nulls last, {key}) as k from {table}) where {keep}"


ORACLES = {
    "p3_found": " union all ".join(_ranked(t, at, key, "k > 1 and source_key is not null") for t, at, key in DELIVERED),
    "p3_kept": " union all ".join(_ranked(t, at, key, "k = 1 or source_key is null", f", source_key, epoch_us({at}) as arrived_us") for t, at, key in DELIVERED),
    "p3_new": """
        select delivery_id, source_key from (select *, row_number() over (partition by source_key order by arrived_at nulls last, delivery_id) as k from parsed_turns)
        where (k = 1 or source_key is null) and (source_key is null or source_key not in (select source_key from session_turns where source_key is not null))""",
}
