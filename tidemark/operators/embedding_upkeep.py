"""The vector column of memories rewritten by another embedder, and duplicates merged on the new vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.embedding import Embedder, embed
from tidemark.functions.hashing import hash_embedding


def reembed(memories: DataFrame, dim: int, make_embedder: Callable[[], Embedder] | None = None) -> DataFrame:
    """``memories`` with a new ``embedding`` of their content, of width ``dim``; all other columns and the order of them stay.

    Without a provider the hashing embedder is used. Null contents get none.
    """
    new: Column = hash_embedding(F.col("content"), dim) if make_embedder is None else embed(F.col("content"), make_embedder, dim)
    return memories.withColumn("embedding", F.when(F.col("content").isNotNull(), new))
