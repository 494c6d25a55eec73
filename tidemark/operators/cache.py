"""Decisions of a semantic query cache, and how it would have fared on a workload."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.decay import instant
from tidemark.functions.vectors import dot


class ResultMemo:
    """Results by request key for one version of the store: at most ``size`` of them, each for ``ttl`` seconds.

    A write publishes a new version, so what was kept before it is never served after it.
    """

    def __init__(self, size: int = 128, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.size, self.ttl, self.clock = size, ttl, clock
        self.kept: OrderedDict[tuple[str, int], tuple[float, object]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str, version: int, compute: Callable[[], object]) -> object:
        now = self.clock()
        found = self.kept.get((key, version))
        if found and now - found[0] < self.ttl:
            self.kept.move_to_end((key, version))
            self.hits += 1
            return found[1]
        self.misses += 1
        value = compute()
        for old in [k for k in self.kept if k[1] != version]:
            del self.kept[old]
        self.kept[(key, version)] = (now, value)
        self.kept.move_to_end((key, version))
        while len(self.kept) > self.size:
            self.kept.popitem(last=False)
        return value


class QueryCache(ResultMemo):
    """A memo that also answers questions near one it has answered: same parameters, similar enough, and clearly nearest."""

    def __init__(self, settings: Settings = DEFAULTS, size: int = 128, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        super().__init__(size, ttl, clock)
        self.settings = settings
        self.vectors: OrderedDict[str, tuple[str, np.ndarray, int]] = OrderedDict()

    def lookup(self, key: str, version: object) -> object | None:
        """What is kept under a key for a version, if it hasn't expired."""
        found = self.kept.get((key, version))
        return found[1] if found and self.clock() - found[0] < self.ttl else None

    def semantic(self, fingerprint: str, vector: np.ndarray, version: object) -> tuple[str, str | None, float | None]:
        """Outcome, the key served and the best similarity, over at most ``size`` entries."""
        live = [(float(vector @ v), k) for k, (f, v, _) in self.vectors.items() if f == fingerprint and len(v) == len(vector) and self.lookup(k, version) is not None]
        if not live:
            return "no_candidates", None, None
        (best, key), *rest = sorted(live, key=lambda x: -x[0])
        if best < self.settings.cache_threshold:
            return "below_threshold", None, best
        if rest and best - rest[0][0] < self.settings.cache_margin:
            return "ambiguous", None, best
        return "served", key, best

    def put(self, key: str, fingerprint: str, vector: np.ndarray, version: object, value: object) -> None:
        self.get(key, version, lambda: value)
        self.vectors[key] = (fingerprint, vector, 0)
        for old in [k for k in self.vectors if (k, version) not in self.kept]:
            del self.vectors[old]


THRESHOLDS = tuple(round(0.70 + 0.025 * i, 3) if i < 11 else (0.97, 0.99)[i - 11] for i in range(13))
SWEEP = "threshold double, requests int, exact_hits int, semantic_hits int, misses int, false_hits int, refused_ambiguous int, refused_below_threshold int"


def decide(queries: DataFrame, entries: DataFrame, as_of, settings: Settings = DEFAULTS) -> DataFrame:  # noqa: ANN001
    """``query_id``, ``outcome``, ``served_id``, ``best_similarity``, ``runner_up``, ``candidates`` for each query.

    Entries count that have the query's fingerprint and width and haven't expired. A winner below the threshold, or less
    than the margin ahead of the next, isn't served. Queries and entries meet by fingerprint and the best two of each
    query are kept where they are computed, so entries of one fingerprint aren't gathered.
    """
    whole = ~F.exists("embedding", lambda x: x.isNull())
    live = entries.where((F.col("expires_at") > instant(as_of)) & whole).select("fingerprint", F.size("embedding").alias("_w"), "entry_id", F.col("embedding").alias("_e"))
    asked = queries.where(whole).select("query_id", "fingerprint", F.size("embedding").alias("_w"), F.col("embedding").alias("_q"))
    scored = asked.join(live, ["fingerprint", "_w"]).select("query_id", dot(F.col("_q"), F.col("_e")).alias("s"), "entry_id")
    # Every partition keeps its best two of a query before they are shuffled; nothing is multiplied twice.
    two = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "entry_id"))).where("r <= 2")
    best = two.groupBy("query_id").agg(F.max(F.when(F.col("r") == 1, F.struct("s", (-F.col("entry_id")).alias("i")))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("runner_up"))
    met = asked.join(live.groupBy("fingerprint", "_w").agg(F.count("*").alias("candidates")), ["fingerprint", "_w"]).select("query_id", "candidates")
    out = queries.select("query_id").join(best, "query_id", "left").join(met, "query_id", "left")
    s = F.col("top.s")
    outcome = (
        F.when(s.isNull(), "no_candidates")
        .when(s < settings.cache_threshold, "below_threshold")
        .when(F.col("runner_up").isNotNull() & (s - F.col("runner_up") < settings.cache_margin), "ambiguous")
        .otherwise("served")
    )
    return out.select("query_id", outcome.alias("outcome"), F.when(outcome == "served", -F.col("top.i")).alias("served_id"), s.alias("best_similarity"), "runner_up", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))


def round_robin(queries: DataFrame, rounds: int = 2) -> DataFrame:
    """The workload: ``rounds`` times the first of every group, then the second of every group, and so on."""
    w = Window.partitionBy("query_group").orderBy("query")
    ranked = queries.withColumn("idx", F.row_number().over(w))
    every = ranked.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return every.withColumn("at", F.struct("round", "idx", "query_group"))


def replay(keys: list[str], similarity: np.ndarray, same: np.ndarray, threshold: float, margin: float) -> dict[str, int]:
    """How one workload fares at a threshold, as a table of outcomes.

    ``keys`` are the distinct questions in order of their first request; ``similarity`` and ``same`` compare them, ``same``
    saying whether both question and answer agree. A request is answered exactly if its question was stored before. Any
    other is decided on the stored questions: by the nearest, the later stored one of equals, and the distance to the
    next. What isn't served is stored.
    """
    stored = np.zeros(len(keys), bool)
    age = np.full(len(keys), -1)
    outcome = {"exact": 0, "served": 0, "wrong": 0, "ambiguous": 0, "below": 0, "first": 0}
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    for step, q in enumerate(number[k] for k in keys):
        if stored[q]:
            outcome["exact"] += 1
            continue
        known = np.flatnonzero(stored)
        if len(known):
            rank = known[np.lexsort((-age[known], -similarity[q, known]))]
            near = similarity[q, rank[:2]]
            clear = len(near) < 2 or near[0] - near[1] >= margin
            if near[0] >= threshold and clear:
                outcome["served"] += 1
                outcome["wrong"] += int(not same[q, rank[0]])
                continue
            outcome["below" if near[0] < threshold else "ambiguous"] += 1
        else:
            outcome["first"] += 1
        stored[q], age[q] = True, step
    return outcome


def sweep(queries: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, margin: float = 0.02, rounds: int = 2) -> DataFrame:
    """:func:`replay` at each threshold, one task for each; the workload (``query_group``, ``query``, ``embedding``, ``result_ids``) is a labelled set and small.

    A false hit is one whose stored question or answer differs; a miss is whatever had to be computed.
    """
    rows = round_robin(queries, rounds).orderBy("at").select("query_group", "query", "embedding", "result_ids").collect()  # the labelled set
    requests = [r["query"] for r in rows]
    distinct = {r["query"]: r for r in rows}
    x = np.array([r["embedding"] for r in distinct.values()], np.float64).reshape(len(distinct), -1)
    similarity = np.array([[float(a @ b) for b in x] for a in x]).reshape(len(x), len(x))
    answers = [(r["query_group"], tuple(r["result_ids"])) for r in distinct.values()]
    same = np.array([[a == b for b in answers] for a in answers], bool).reshape(len(x), len(x))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for t in pdf["threshold"]:
                o = replay(requests, similarity, same, t, margin)
                out.append((t, len(requests), o["exact"], o["served"], o["ambiguous"] + o["below"] + o["first"], o["wrong"], o["ambiguous"], o["below"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SWEEP.split(", ")])

    spark = queries.sparkSession
    return spark.createDataFrame([(float(t),) for t in thresholds], "threshold double").repartition(len(thresholds)).mapInPandas(run, SWEEP)


def separability(pairs: DataFrame) -> DataFrame:
    """From labelled pairs (``label``, ``similarity``): least similarity that should hit, greatest that must not, and whether they part."""
    least = F.min(F.when(F.col("label") == "positive", F.col("similarity")))
    most = F.max(F.when(F.col("label") == "negative", F.col("similarity")))
    return pairs.agg(least.alias("least_positive"), most.alias("greatest_negative"), (most < least).alias("separable"), F.count_if(F.col("label") == "positive").alias("positives"), F.count_if(F.col("label") == "negative").alias("negatives"))


def query_pairs(queries: DataFrame) -> DataFrame:
    """All pairs of a labelled query set with their similarity and label: same question and answer, different question, or unstable."""
    a = queries.select(F.col("query").alias("qa"), F.col("query_group").alias("ga"), F.col("embedding").alias("ea"), F.col("result_ids").alias("ra"))
    b = queries.select(F.col("query").alias("qb"), F.col("query_group").alias("gb"), F.col("embedding").alias("eb"), F.col("result_ids").alias("rb"))
    label = F.when(F.col("ga") != F.col("gb"), "negative").when(F.col("ra") == F.col("rb"), "positive").otherwise("unstable")
    return a.join(b, F.col("qa") < F.col("qb")).select("qa", "qb", label.alias("label"), dot(F.col("ea"), F.col("eb")).alias("similarity"))


def operating_point(sweep_rows: DataFrame) -> DataFrame:
    """The lowest threshold with hits and no false one; else the one with the least share of false hits."""
    share = F.when(F.col("semantic_hits") > 0, F.col("false_hits") / F.col("semantic_hits"))
    rows = sweep_rows.where("semantic_hits > 0").withColumn("false_share", share)
    return rows.orderBy("false_share", "threshold").limit(1)


def hit_statistics(requests: DataFrame) -> DataFrame:
    """Hits and misses by request, each counted once (``outcome`` of each request)."""
    hit = F.col("outcome").isin("exact", "served")
    return requests.agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.count_if(hit) / F.nullif(F.count("*"), F.lit(0)), 4).alias("hit_rate"))
