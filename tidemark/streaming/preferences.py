"""Preferences written onto the long-term tier in order: a log of events beside the snapshot they apply to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import DEFAULTS, Settings
from tidemark.operators.memories import fold, write_events
from tidemark.operators.store import SnapshotStore
from tidemark.schemas import MEMORIES
from tidemark.session import cut

COMPACT = 64  # batches of events after which the state is written as a snapshot


def renumber(state: DataFrame) -> DataFrame:
    """Memories with lasting ids: the new ones, which bear negative ids, go on from the largest."""
    top = state.agg(F.coalesce(F.max(F.when(F.col("id") >= 0, F.col("id"))), F.lit(0)).alias("_top"))
    lasting = F.when(F.col("id") < 0, F.col("_top") - F.col("id"))
    link = F.when(F.col("superseded_by") < 0, F.col("_top") - F.col("superseded_by"))
    return state.crossJoin(F.broadcast(top)).withColumn("id", F.coalesce(lasting, "id")).withColumn("superseded_by", F.coalesce(link, "superseded_by")).drop("_top")  # one row


def apply_writes(memories: DataFrame, writes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The memories after ``writes`` (``write_id`` from 1, ``written_at``, ``namespace``, ``category``, ``content``, ``embedding``, ``supersede``)."""
    return renumber(fold(memories, write_events(memories, writes, settings)))


class MemoryLog:
    """The long-term tier in a store: a snapshot, and two logs of events since it, of writes and of accesses.

    A write or an access appends its events and reads the state; it rewrites nothing. Logs are named by the snapshot's
    version and a new snapshot starts new ones, so no event is ever applied to a snapshot that holds it already.
    """

    def __init__(self, store: SnapshotStore, table: str = "memories") -> None:
        self.store, self.table = store, table

    def _log(self, kind: str) -> str:
        return f"{self.table}_{kind}_{self.store.version(self.table)}"

    def version(self) -> tuple[int, int]:
        """Changes with every write; accesses don't count."""
        return self.store.version(self.table), self.store.version(self._log("log"))

    def state(self) -> DataFrame:
        base = self.store.read(self.table) if self.store.version(self.table) else self.store.spark.createDataFrame([], MEMORIES)
        logs = [self.store.read(x) for x in (self._log("log"), self._log("access")) if self.store.version(x)]
        return fold(base, logs[0] if len(logs) == 1 else logs[0].unionByName(logs[1])) if logs else base

    def append(self, events: DataFrame, kind: str = "log", tag: str = "") -> None:
        """Appends events; the logs so far go into a snapshot first if they are many, so that a tag just written stays known."""
        if self.store.has_tag(self._log(kind), tag):
            return
        if self.store.version(self._log(kind)) >= COMPACT:
            events = cut(events)
            self.replace(self.state())
        self.store.append(self._log(kind), events, tag)

    def replace(self, memories: DataFrame) -> None:
        """A new snapshot, in which all events so far are contained."""
        self.store.publish(self.table, cut(memories.select(*[F.col(f.name).cast(f.dataType) for f in MEMORIES])))

    def write(self, writes: DataFrame, settings: Settings = DEFAULTS, tag: str = "") -> DataFrame:
        """Applies writes one after the other and returns their events, which bear the lasting ids."""
        state = cut(self.state())
        top = state.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

        def lasting(c: str):  # noqa: ANN202
            return F.when(F.col(c) < 0, F.lit(top) - F.col(c)).otherwise(F.col(c)).alias(c)

        events = write_events(state, writes, settings)
        events = cut(events.select(*[lasting(c) if c in ("id", "other") else F.col(c) for c in events.columns]))
        self.append(events, tag=tag)
        return events


def write_stream(stream: DataFrame, store: SnapshotStore, checkpoint: str, *, table: str = "memories", settings: Settings = DEFAULTS) -> StreamingQuery:
    """Applies each batch to the store as if its rows had been written one by one; a batch that is played again is known by its number."""
    log = MemoryLog(store, table)

    def batch(df: DataFrame, epoch: int) -> None:
        tag = f"{checkpoint.rstrip('/').split('/')[-1]}.{epoch}"
        if not store.has_tag(log._log("log"), tag):
            log.write(df, settings, tag)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
