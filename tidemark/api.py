"""The operations of a memory service over a snapshot store, each a plan that is run when its result is asked for."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.hashing import TOKENS, embed_tokens, hash_embedding, request_key
from tidemark.functions.timez import window_days
from tidemark.functions.validation import candidate_violations, memory_violations
from tidemark.operators import cards, memories, patterns, review, turns
from tidemark.operators.cache import QueryCache
from tidemark.operators.store import SnapshotStore
from tidemark.schemas import CANDIDATES, CARDS, CURSORS, MEMORIES, TURNS
from tidemark.session import cut
from tidemark.streaming.ingest import current, shaped, write_turns
from tidemark.streaming.preferences import MemoryLog

SCHEMAS = {"turns": TURNS, "cards": CARDS, "memories": MEMORIES, "candidates": CANDIDATES, "cursors": CURSORS}
HITS = "id long, content string, namespace string, category string, created_at timestamp, valid_at timestamp, superseded_by long, cosine_similarity double, decay_multiplier double, age_days double, score double"


@dataclass(frozen=True)
class Recall:
    """What a question finds: at most ``top_k`` rows, the text a model is given, and which layer answered."""

    rows: list[Row]
    context_block: str
    layer: str  # "exact", "semantic" or "search"
    semantic: tuple[str, str | None, float | None] | None = None

    @property
    def cache_hit(self) -> bool:
        return self.layer != "search"


def context_block(rows: Sequence[Row]) -> str:
    """The hits as lines with id, provenance and scores."""
    # The sentences of the context text.
    if not rows:
        return "No stored memory matched this query."
    lines = ["Known T3 memories (most relevant first):"]
    for r in rows:
        state = "open" if r["valid_at"] is None else f"superseded {r['valid_at']:%Y-%m-%d}"
        lines.append(f"- [{r['id']}] {r['content']} (namespace={r['namespace']}, category={r['category']}, learned={r['created_at']:%Y-%m-%d}, {state}, cosine={r['cosine_similarity']:.3f}, score={r['score']:.3f})")
    return "\n".join(lines)


class MemoryEngine:
    """Sessions, cards, memories and pattern candidates under one folder. ``now`` is given with every call that needs it."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.settings, self.store = spark, settings, SnapshotStore(spark, root)
        self.memories, self.cache = MemoryLog(self.store), QueryCache(settings)

    def table(self, name: str) -> DataFrame:
        return self.memories.state() if name == "memories" else current(self.store, name, SCHEMAS[name])

    def _save(self, name: str, df: DataFrame) -> None:
        self.store.publish(name, cut(shaped(df, SCHEMAS[name])))

    def _embed(self, text: str) -> np.ndarray:
        return embed_tokens(re.findall(TOKENS, text.lower()), self.settings.embedding_dim, {})

    def health(self) -> dict[str, object]:
        return {"tables": {n: self.table(n).count() for n in SCHEMAS}, "embedding_dim": self.settings.embedding_dim, "decay_per_day": self.settings.decay_per_day}

    def add_turns(self, new: DataFrame) -> None:
        """Appends turns; what is stored isn't rewritten."""
        stored = self.table("turns")
        rows = turns.filled(new)
        self.store.append("turns", cut(shaped(turns.numbered(rows, stored), TURNS)))
        self.store.compact("turns")

    def append_many(self, rows: DataFrame) -> int:
        return write_turns(self.store, rows)

    def read_buffer(self, session_id: str) -> DataFrame:
        return turns.session_window(self.table("turns").where(F.col("session_id") == session_id), self.settings.window_turns)

    def evicted(self, session_id: str) -> DataFrame:
        return turns.evicted(self.table("turns").where(F.col("session_id") == session_id), self.settings.window_turns)

    def list_turns_between(self, start: str, end: str, limit: int = 40) -> tuple[DataFrame, int]:
        t = self.table("turns")
        return turns.between(t, start, end, limit), t.where(turns.in_range(start, end)).count()

    def write_summary(self, written: DataFrame) -> None:
        self._save("cards", cards.upsert(self.table("cards"), written))

    def list_summaries(self, session_id: str | None = None, limit: int = 30, scope: str = "day") -> DataFrame:
        return cards.listed(self.table("cards"), scope=scope, session_id=session_id, limit=limit)

    def get_summary(self, period: str, session_id: str | None = None) -> DataFrame:
        return cards.get(self.table("cards"), period, session_id)

    def set_narrative(self, updates: DataFrame) -> None:
        self._save("cards", cards.narrate(self.table("cards"), updates))

    def upsert_preferences(self, rows: DataFrame) -> DataFrame:
        """Writes (``write_id``, ``written_at``, ``namespace``, ``category``, ``content``, ``supersede``, ``confirmed``), embedded by hashing; all must be sound.

        Returns what each write did, with lasting ids.
        """
        checked = rows.withColumn("_v", memory_violations(namespace=F.col("namespace"), category=F.col("category"), content=F.col("content"), decay_factor=F.lit(1.0), confirmed=F.col("confirmed")))
        bad = checked.where(F.size("_v") > 0).select("write_id", "_v").limit(1).collect()
        if bad:
            raise ValueError(f"write {bad[0][0]} violates {', '.join(bad[0][1])}")
        return self.memories.write(rows.withColumn("embedding", hash_embedding(F.col("content"), self.settings.embedding_dim)), self.settings)

    def list_memories(self, now: str, limit: int = 50, include_closed: bool = True, namespaces: Sequence[str] | None = None) -> DataFrame:
        return memories.list_recent(self.table("memories"), now, limit=limit, include_closed=include_closed, namespaces=namespaces, settings=self.settings)

    def recall(self, query: str, now: str, *, top_k: int = 5, window: str = "all", include_closed: bool = False, namespaces: Sequence[str] | None = None, categories: Sequence[str] | None = None) -> Recall:
        """Answers a question from the same one, from one near it, or by a decayed search, in this order.

        Kept answers hold until the next write. What a search finds counts an access; kept answers don't. A question is
        only near another if everything else about the requests is the same.
        """
        params = {"k": top_k, "w": window, "c": sorted(categories or ()), "n": sorted(namespaces or ()), "s": include_closed}
        key, fingerprint = request_key(query, params)
        version = self.memories.version()
        if (kept := self.cache.lookup(key, version)) is not None:
            return Recall(kept.rows, kept.context_block, "exact")
        vector = self._embed(query)
        semantic = self.cache.semantic(fingerprint, vector, version)
        if semantic[0] == "served":
            kept = self.cache.lookup(semantic[1], version)
            return Recall(kept.rows, kept.context_block, "semantic", semantic)
        found = memories.search(self.table("memories"), vector.tolist(), now, top_k=top_k, settings=self.settings, include_closed=include_closed, within_days=window_days(window), namespaces=namespaces, categories=categories)
        rows = found.select(*[c.split()[0] for c in HITS.split(", ")]).collect()  # at most ``top_k``
        out = Recall(rows, context_block(rows), "search", semantic)
        if rows:
            hits = self.spark.createDataFrame([(r["id"],) for r in rows], "id long")
            self.memories.append(memories.access_events(hits, now), "access")
        self.cache.put(key, fingerprint, vector, self.memories.version(), out)
        return out

    def temporal_query(self, query: str, now: str, **how: object) -> DataFrame:
        """The rows of :meth:`recall`, in order of their score."""
        return self.spark.createDataFrame(self.recall(query, now, **how).rows, HITS)

    def archive(self, memory_id: int, now: str) -> None:
        """Closes a memory without replacement."""
        hit = self.table("memories").where((F.col("id") == memory_id) & F.col("valid_at").isNull()).select("id")
        self.memories.append(memories.access_events(hit, now, "archived"))

    def propose_pattern(self, rows: DataFrame, now: str) -> None:
        """Stores candidates (``description``, ``supporting_evidence``, ``contexts``, ``confidence``) as pending; all must be sound."""
        checked = rows.withColumn("_v", candidate_violations(description=F.col("description"), evidence=F.col("supporting_evidence"), contexts=F.col("contexts"), confidence=F.col("confidence")))
        bad = checked.where(F.size("_v") > 0).select("description", "_v").limit(1).collect()
        if bad:
            raise ValueError(f"candidate {bad[0][0]!r} violates {', '.join(bad[0][1])}")
        at = F.lit(now).cast("timestamp")
        old = self.table("candidates")
        new = turns.numbered(rows.select("description", "supporting_evidence", "contexts", "confidence"), old).withColumns({"status": F.lit("pending"), "created_at": at, "updated_at": at})
        self._save("candidates", old.unionByName(new.withColumn("confidence", F.col("confidence").cast("float")), allowMissingColumns=True))

    def list_patterns(self, status: str | None = "pending", limit: int = 20) -> DataFrame:
        return patterns.listed(self.table("candidates"), status=status, limit=limit)

    def resolve_patterns(self, decisions: DataFrame, now: str) -> None:
        """Decides candidates; a confirmed or edited one is written as a memory, whose id it keeps."""
        after, writes = patterns.resolve(self.table("candidates"), decisions, now)
        after, writes = cut(after), cut(writes)
        if not writes.isEmpty():
            events = self.upsert_preferences(writes.select(F.col("candidate_id").alias("write_id"), "written_at", "namespace", "category", "content", F.lit(False).alias("supersede"), F.lit(True).alias("confirmed")))
            wrote = events.where(F.col("event").isin("inserted", "refreshed")).select(F.col("seq").alias("id"), F.col("id").alias("_memory"))
            after = after.join(wrote, "id", "left").withColumn("confirmed_memory_id", F.coalesce("_memory", "confirmed_memory_id")).drop("_memory")
        self._save("candidates", after)

    def daily_review(self, today: str, period: str = "latest", tz: str = "UTC") -> DataFrame:
        return review.daily_review(self.table("cards"), self.table("memories"), self.table("candidates"), period=period, today=today, tz=tz)

    def as_of_day(self, day: str, tz: str = "UTC") -> DataFrame:
        return memories.timeline(self.table("memories"), day, tz)


def utc_now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
