"""Ingestion, in batches and as a stream: changed files are read on from their cursors, turns are stored once, and the
cards of touched days and sessions are built again from the whole store, under the narratives they have."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import DEFAULTS
from tidemark.functions.decay import instant
from tidemark.functions.timez import local_date
from tidemark.operators import cards, digest
from tidemark.operators.store import SnapshotStore
from tidemark.operators.turns import changes, numbered
from tidemark.schemas import CARDS, CURSORS, TURNS
from tidemark.session import cut
from tidemark.sources import cursors, flat_log, lines, nested_log
from tidemark.sources.growing import grown_files

Parse = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Reader:
    """A kind of log: its name in keys, the files it takes, its parser, and whether a changed file is read whole.

    Flat logs carry state from line to line, so a changed file is read whole; keys keep its turns from being stored twice.
    """

    name: str
    pattern: str
    parse: Callable[..., tuple[DataFrame, DataFrame]]
    whole: bool = False


READERS = {"nested": Reader("nested-log", "*.jsonl", nested_log.parse), "flat": Reader("flat-log", "rollout-*.jsonl", flat_log.parse, True)}


def current(store: SnapshotStore, table: str, schema) -> DataFrame:  # noqa: ANN001
    """A table of the store; empty before its first version."""
    return store.read(table) if store.version(table) else store.spark.createDataFrame([], schema)


def shaped(df: DataFrame, schema) -> DataFrame:  # noqa: ANN001
    """The columns of a schema in its order and types; absent ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def as_rows(turns: DataFrame) -> DataFrame:
    """Parsed turns as rows of the store; a session is named by its source too."""
    return turns.select(
        F.concat_ws(":", "source", "session_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("source").alias("tool"),
        "token_count", "created_at", "source_key", "project", "git_branch", "tool_names",
    )


def write_turns(store: SnapshotStore, rows: DataFrame) -> int:
    """Stores the turns of a batch by key; returns how many were new. The stored ones are rewritten only if some change."""
    stored = current(store, "turns", TURNS)
    new, altered = changes(stored, rows)
    new, altered = cut(shaped(numbered(new, stored), TURNS)), cut(altered)
    if altered.isEmpty():
        store.append("turns", new)
        store.compact("turns")
    else:
        store.publish("turns", shaped(stored.join(altered.select("id"), "id", "left_anti").unionByName(altered).unionByName(new), TURNS))
    return new.count()


def write_cards(store: SnapshotStore, written: DataFrame) -> int:
    """Lays cards over the stored ones: narratives and threads stay. Returns how many were written."""
    written = cut(written)
    store.publish("cards", cut(shaped(cards.upsert(current(store, "cards", CARDS), written), CARDS)))
    return written.count()


def store_batch(store: SnapshotStore, turns: DataFrame, tz: str, *, now: str | None = None, day_cards: bool = True, session_cards: bool = True, min_session_turns: int = DEFAULTS.min_session_turns) -> int:
    """Stores one batch of turns and writes the cards of its days; returns how many turns were new.

    A batch that is stored again changes nothing, so a failure between the two steps is harmless.
    """
    rows = cut(as_rows(turns))
    n = write_turns(store, rows)
    if day_cards or session_cards:
        days = rows.where("created_at is not null").select(local_date(F.col("created_at"), tz).cast("string").alias("period")).distinct()
        at = instant(now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S"))
        write_cards(store, digest.written_cards(store.read("turns"), cut(days), tz, at, days=day_cards, sessions=session_cards, min_turns=min_session_turns))
    return n


def ingest_files(
    store: SnapshotStore, files: DataFrame, reader: Reader, now: str, *, tz: str = DEFAULTS.timezone, since: str | None = None, full: bool = False, dry_run: bool = False,
    hot_after: str | None = None, day_cards: bool = True, session_cards: bool = True, min_session_turns: int = DEFAULTS.min_session_turns, options: dict[str, object] | None = None,
) -> dict[str, int]:
    """Reads on in the files (``path``, ``modificationTime``, ``length``, perhaps ``hot``) that changed since they were read.

    Turns are stored before cards, and cards before cursors: whatever fails, the next run reads the same bytes again and
    stores nothing twice. The last group of a hot file is held back and its cursor stays before it.
    """
    known = current(store, "cursors", CURSORS)
    mine = known.where(F.col("source") == reader.name)
    files = cursors.unread(files, mine, full=full)
    read = lines.read_lines(files, None if full or reader.whole else mine, hot_after=hot_after)
    found, metrics = reader.parse(read, reader.name, **(options or {}))
    found, metrics = cut(found if since is None else found.where(F.col("created_at") >= instant(since))), cut(metrics)
    n = metrics.agg(F.count("*").alias("files"), F.coalesce(F.sum("malformed_lines"), F.lit(0)).alias("malformed")).first()
    t = found.agg(F.count("*").alias("turns"), F.coalesce(F.sum("redactions"), F.lit(0)).alias("masked")).first()
    out = {"files": n["files"], "turns": t["turns"], "masked": t["masked"], "malformed": n["malformed"]}
    if dry_run:
        return out
    out["new"] = store_batch(store, found, tz, now=now, day_cards=day_cards, session_cards=session_cards, min_session_turns=min_session_turns)
    store.publish("cursors", cut(shaped(cursors.advance(known, metrics, found, reader.name, now), CURSORS)))
    return out


def ingest_all(store: SnapshotStore, roots: Iterable[tuple[str, str]], now: str, *, since: str | None = None, **how: object) -> dict[str, int]:
    """Several kinds of logs in one run, each (kind, folder); the counts add up."""
    total: dict[str, int] = {}
    minute_ago = (dt.datetime.fromisoformat(now) - dt.timedelta(seconds=60)).isoformat(" ")
    for kind, root in roots:
        reader = READERS[kind]
        files = lines.discover(store.spark, root, reader.pattern, since=since)
        files = files.where(lines.is_rollout(F.col("path"))) if kind == "flat" else files
        given = dict(how)
        given["options"] = given.get("options") if kind == "nested" else None
        for k, v in ingest_files(store, files, reader, now, since=since, hot_after=minute_ago, **given).items():
            total[k] = total.get(k, 0) + v
    return total


def ingest_stream(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, *, tz: str = "UTC", kind: str = "nested", hot_seconds: float = 60.0, trigger: dict[str, object] | None = None, **how: object) -> StreamingQuery:
    """Ingests what was added to the logs of a folder, also to files that were read before; stops then, or goes on by ``trigger``.

    Exactly-once by key and cursor, whatever is delivered again.
    """
    reader = READERS[kind]

    def batch(df: DataFrame, _epoch: int) -> None:
        files = df.where(lines.is_rollout(F.col("path"))) if kind == "flat" else df
        now = dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
        ingest_files(store, cut(files), reader, now, tz=tz, **how)

    found = grown_files(spark, folder, reader.pattern, hot_seconds=hot_seconds)
    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
