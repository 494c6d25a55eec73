"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component``: the least node that can be reached from ``node`` over edges (``a``, ``b``).

    Large and small stars alternate: the number of edges never grows, so a hub of any degree stays within its aggregate;
    each round is cut from its lineage.
    """
    e = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))
        new = cut(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            roots = new.groupBy("v").agg(F.min("u").alias("component"))
            return roots.select(F.col("v").alias("node"), "component").union(roots.select(F.col("component").alias("node"), "component").distinct())
        e = new
