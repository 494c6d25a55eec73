"""Embeddings from a provider that is made once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def embed(text: Column, make_embedder: Callable[[], Embedder], dim: int, *, batch: int = 32) -> Column:
    """Vectors at unit length, ``batch`` texts a call; null texts give null, a vector of another width is an error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make_embedder()
        for texts in batches:
            out: list[np.ndarray | None] = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, v in zip(part, provider([texts.iloc[j] for j in part]), strict=True):
                    if len(v) != dim:
                        raise ValueError(f"the provider gave {len(v)} numbers, not {dim}")
                    x = np.asarray(v, np.float64)
                    n = np.linalg.norm(x)
                    out[i] = (x / n if n else np.eye(1, dim)[0]).astype(np.float32)
            yield pd.Series(out)

    return F.pandas_udf(run, "array<float>")(text)
