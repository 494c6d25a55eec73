"""Hashes that no built-in function offers: stable positions, keys and the hashing embedder."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = r"[a-z0-9_]+|[一-鿿]"


def position(value: str) -> float:
    """A stable place of a string between 0 and 1."""
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") / 2**64


def request_key(query: str, params: dict[str, object]) -> tuple[str, str]:
    """The key of a request, which its query's case and outer white space don't change, and the fingerprint of its parameters."""
    plain = json.dumps(params, sort_keys=True, default=str)
    whole = json.dumps({"q": query.strip().lower(), "p": plain}, sort_keys=True)
    return hashlib.blake2b(whole.encode(), digest_size=16).hexdigest(), hashlib.blake2b(plain.encode(), digest_size=8).hexdigest()


@F.pandas_udf(T.DoubleType())
def stable_position(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else position(v))


@F.pandas_udf(T.StringType())
def short_digest(values: pd.Series) -> pd.Series:
    """24 hexadecimal digits."""
    return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=12).hexdigest())


@F.pandas_udf(T.StringType())
def prompt_digest(values: pd.Series) -> pd.Series:
    """16 hexadecimal digits."""
    return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=8).hexdigest())


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKENS})"), F.lit(1))


def embed_tokens(words: list[str], dim: int, known: dict[str, tuple[int, float]]) -> np.ndarray:
    """Signed counts in ``dim`` buckets at unit length; the first unit vector without tokens."""
    out = np.zeros(dim)
    for w in words:
        at = known.get(w)
        if at is None:
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            at = known[w] = (int.from_bytes(d[:4], "big") % dim, 1.0 if d[4] & 1 else -1.0)
        out[at[0]] += at[1]
    n = np.linalg.norm(out)
    if n == 0:
        out[0] = n = 1.0
    return out / n


def hash_embedding(text: Column, dim: int) -> Column:
    """An embedding that knows the words of a text and nothing of their meaning; for tests and offline use."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        return batch.map(lambda words: embed_tokens(list(words), dim, known).astype(np.float32))

    return run(tokens(text))
