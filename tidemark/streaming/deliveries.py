"""Exactly-once storage of a stream of messages that may be delivered again at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.delivery import first_deliveries, new_deliveries
from tidemark.operators.store import SnapshotStore
from tidemark.session import cut


def keep_first(stream: DataFrame, store: SnapshotStore, table: str, checkpoint: str, *, key: str, arrived: str, row_id: str) -> StreamingQuery:
    """Appends the first delivery of each identifier to a table of the store; earlier batches win over later ones.

    History is unbounded, so identifiers are looked up in the store and not in a state with a watermark. A batch is an
    increment of what is new in it; of what is stored only the identifiers are read.
    """

    def batch(df: DataFrame, _epoch: int) -> None:
        fresh = new_deliveries(df, store.read(table), key, arrived, row_id) if store.version(table) else first_deliveries(df, key, arrived, row_id)
        store.append(table, cut(fresh))
        store.compact(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
