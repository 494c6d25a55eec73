"""Measures of quality, size and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Counts, accuracy, precision and recall; a measure with nothing to measure is null."""
    tp, fp = F.count_if(expected & actual), F.count_if(~expected & actual)
    fn, tn = F.count_if(expected & ~actual), F.count_if(~expected & ~actual)

    def rate(a: Column, b: Column) -> Column:
        return F.round(a / F.nullif(b, F.lit(0)), 4)

    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"))


def compression(rows: DataFrame) -> DataFrame:
    """Percent of tokens saved by a card and what is recalled, against the raw turns (``raw_tokens``, ``card_tokens``, ``recall_tokens``)."""
    raw, packed = F.avg("raw_tokens"), F.avg(F.col("card_tokens") + F.col("recall_tokens"))
    return rows.agg(raw.alias("raw"), packed.alias("packed"), F.round((raw - packed) / F.nullif(raw, F.lit(0.0)) * 100, 1).alias("reduction_percent"))


def token_cost(rows: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Tokens and their price by model; ``prices`` holds (input, output) for a million tokens."""
    out = rows.groupBy("model").agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    if not prices:
        return out.withColumn("cost", F.lit(None).cast("double"))
    table = F.create_map(*[x for m, (i, o) in prices.items() for x in (F.lit(m), F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")))])
    p = F.element_at(table, F.col("model"))
    return out.withColumn("cost", F.col("input_tokens") / 1e6 * p["i"] + F.col("output_tokens") / 1e6 * p["o"])


def local_cost(wall_seconds: Column, rate_per_hour: float) -> Column:
    """What a run on one's own machine costs at an hourly rate."""
    return wall_seconds / 3600.0 * rate_per_hour
