"""Command line over a store: ingest logs, rebuild cards, extract and replay, mine patterns, re-embed and merge memories, show the state."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.api import MemoryEngine
from tidemark.config import DEFAULTS
from tidemark.functions.decay import instant
from tidemark.functions.timez import local_date, parse_since
from tidemark.operators import cards, dataset, digest, extraction_run, memories, patterns
from tidemark.operators.embedding_upkeep import reembed
from tidemark.operators.store import SnapshotStore
from tidemark.schemas import CARDS, CURSORS
from tidemark.session import build_session, cut
from tidemark.sources import cursors, jsonl
from tidemark.streaming.ingest import READERS, current, ingest_all, shaped, write_cards
from tidemark.streaming.preferences import MemoryLog

SYSTEM = "Write the diary entry of the day as one JSON object with narrative, highlights, preferences and open_threads."


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m tidemark")
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--now", default=dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S"))
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="read logs into turns and cards")
    i.add_argument("--source", choices=sorted(READERS), required=True, action="append", help="with --root, once for each kind of logs")
    i.add_argument("--root", required=True, action="append")
    i.add_argument("--since", help="7d, 14h, 2w or all")
    i.add_argument("--limit-days", type=int, help="only turns of that many days")
    i.add_argument("--timezone", default=DEFAULTS.timezone)
    i.add_argument("--min-session-turns", type=int, default=DEFAULTS.min_session_turns)
    for flag in ("dry-run", "full", "include-tool-io", "include-thinking", "include-sidechains", "no-summaries", "no-session-cards"):
        i.add_argument(f"--{flag}", action="store_true")
    r = sub.add_parser("rebuild-cards", help="build the cards of days again; narratives stay")
    r.add_argument("dates", nargs="*", help="days; all without any")
    r.add_argument("--timezone", default=DEFAULTS.timezone)
    r.add_argument("--min-session-turns", type=int, default=DEFAULTS.min_session_turns)
    m = sub.add_parser("patterns", help="mine pattern candidates from day cards")
    m.add_argument("--since")
    m.add_argument("--limit", type=int, default=20)
    m.add_argument("--card-limit", type=int, default=365)
    m.add_argument("--apply", action="store_true", help="store them as pending")
    g = sub.add_parser("merge", help="merge near-duplicate memories")
    g.add_argument("--threshold", type=float, default=DEFAULTS.dedup_threshold)
    g.add_argument("--apply", action="store_true")
    b = sub.add_parser("reembed", help="embed all memories again")
    b.add_argument("--dim", type=int, default=DEFAULTS.embedding_dim)
    b.add_argument("--embedder", help="module:function that makes one; the hashing embedder without it")
    b.add_argument("--merge-duplicates", action="store_true")
    b.add_argument("--threshold", type=float, default=DEFAULTS.dedup_threshold)
    b.add_argument("--apply", action="store_true")
    e = sub.add_parser("extract", help="narrate cards")
    e.add_argument("--provider", required=True, help="module:function that makes one")
    e.add_argument("--model", default="unknown")
    e.add_argument("--system", default=SYSTEM)
    e.add_argument("--date", nargs="+", help="days; the newest cards without a narrative if none is given")
    e.add_argument("--scope", choices=cards.SCOPES, default="day")
    e.add_argument("--limit", type=int, default=3)
    e.add_argument("--max-attempts", type=int, default=3)
    e.add_argument("--max-input-tokens", type=int, default=12_000)
    e.add_argument("--min-confidence", type=float, default=DEFAULTS.min_confidence)
    e.add_argument("--timezone", default=DEFAULTS.timezone)
    e.add_argument("--log", required=True, help="folder of the captured attempts and pairs")
    for flag in ("no-preferences", "dry-run"):
        e.add_argument(f"--{flag}", action="store_true")
    y = sub.add_parser("replay", help="write captured narratives and preferences again")
    y.add_argument("--log", required=True)
    y.add_argument("--min-confidence", type=float, default=DEFAULTS.min_confidence)
    y.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("split", help="write captured pairs as train and holdout files")
    s.add_argument("--log", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--holdout", type=float, default=0.2)
    sub.add_parser("status", help="files, bytes and turns of each source")
    c = sub.add_parser("reset-cursors", help="forget what was read")
    c.add_argument("--source", choices=sorted(READERS))
    return p


def _made(name: str):  # noqa: ANN202
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def ingest(store: SnapshotStore, a: argparse.Namespace) -> dict[str, int]:
    if len(a.source) != len(a.root):
        raise SystemExit("give a --root for each --source")
    now = dt.datetime.fromisoformat(a.now)
    bounds = [x for x in (parse_since(a.since, now), now - dt.timedelta(days=a.limit_days) if a.limit_days else None) if x]
    options = {"tool_io": a.include_tool_io, "thinking": a.include_thinking, "sidechains": a.include_sidechains}
    return ingest_all(
        store, zip(a.source, a.root, strict=True), a.now, since=str(max(bounds)) if bounds else None, tz=a.timezone, full=a.full, dry_run=a.dry_run, options=options,
        day_cards=not a.no_summaries, session_cards=not a.no_summaries and not a.no_session_cards, min_session_turns=a.min_session_turns,
    )


def rebuild(store: SnapshotStore, a: argparse.Namespace) -> dict[str, int]:
    turns = store.read("turns")
    days = store.spark.createDataFrame([(d,) for d in a.dates], "period string") if a.dates else turns.where("created_at is not null").select(local_date(F.col("created_at"), a.timezone).cast("string").alias("period")).distinct()
    return {"cards": write_cards(store, digest.written_cards(turns, days, a.timezone, instant(a.now), min_turns=a.min_session_turns))}


def mine(engine: MemoryEngine, a: argparse.Namespace) -> list[tuple[str, float]]:
    """What repeats in the newest day cards and isn't a candidate yet, whatever became of it."""
    since = parse_since(a.since, dt.datetime.fromisoformat(a.now))
    day_cards = cards.listed(engine.table("cards"), scope="day", limit=a.card_limit)
    rows = cut(patterns.ordered(patterns.mine(day_cards, engine.table("candidates"), since=str(since.date()) if since else None)).limit(a.limit))
    if a.apply and not rows.isEmpty():
        engine.propose_pattern(rows, a.now)
    return [(r["description"], r["confidence"]) for r in rows.select("description", "confidence").collect()]


def _merge(log: MemoryLog, state, a: argparse.Namespace) -> int:  # noqa: ANN001
    merged = cut(memories.greedy_merge(state, a.threshold))
    if a.apply:
        log.replace(memories.apply_merge(state, merged, a.now))
    return merged.count()


def _write_preferences(engine: MemoryEngine, prefs, now: str) -> dict[str, int]:  # noqa: ANN001
    if prefs.isEmpty():
        return {}
    w = prefs.select(F.row_number().over(_by_date()).cast("long").alias("write_id"), instant(now).alias("written_at"), "namespace", "category", "content", F.lit(False).alias("supersede"), F.lit(False).alias("confirmed"))
    return {r["event"]: r["count"] for r in engine.upsert_preferences(cut(w)).groupBy("event").count().collect()}


def _by_date():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.orderBy("date", "content")  # preferences of one run, a few for each card


def extract(engine: MemoryEngine, a: argparse.Namespace) -> dict[str, int]:
    table = engine.table("cards")
    chosen = cut(table.where(F.col("period").isin(*a.date)) if a.date else extraction_run.due(table, scope=a.scope, limit=a.limit))
    turns = engine.table("turns")
    if a.dry_run:
        return {"prompts": extraction_run.prompts_of(chosen, turns, a.system, a.timezone, max_input_tokens=a.max_input_tokens).count()}
    done = extraction_run.run(chosen, turns, _made(a.provider), instant(a.now), system=a.system, provider=a.provider, model=a.model, tz=a.timezone, max_attempts=a.max_attempts, max_input_tokens=a.max_input_tokens, min_confidence=a.min_confidence)
    # What was paid for is kept first.
    jsonl.append(done.attempts, f"{a.log}/attempts")
    jsonl.append(done.pairs, f"{a.log}/pairs")
    updates = cut(done.updates)
    engine.set_narrative(updates)
    wrote = {} if a.no_preferences else _write_preferences(engine, cut(done.preferences), a.now)
    return {"cards": chosen.count(), "narratives": updates.count()} | wrote


def replay(engine: MemoryEngine, a: argparse.Namespace) -> dict[str, int]:
    pairs = jsonl.pairs(engine.spark, f"{a.log}/pairs", strict=False)
    after, missing, prefs = dataset.replay(pairs, engine.table("cards"), F.col("meta.extracted_at"), a.min_confidence)
    out = {"pairs": dataset.last_pairs(pairs, F.col("meta.extracted_at")).count(), "missing": missing.count(), "preferences": prefs.count()}
    if a.dry_run:
        return out
    engine.store.publish("cards", cut(shaped(after, CARDS)))
    return out | _write_preferences(engine, cut(prefs), a.now)


def split(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    parts = cut(dataset.split(dataset.last_pairs(jsonl.pairs(spark, f"{a.log}/pairs", strict=False), F.col("meta.extracted_at")), a.holdout))
    for name in ("train", "holdout"):
        jsonl.write(dataset.chat_rows(parts.where(F.col("part") == name)), f"{a.out}/{name}")
    rows = dataset.report(parts).collect()
    jsonl.merge_metrics(spark, f"{a.out}/report.json", {"split": {r["part"]: r.asDict() for r in rows}})
    return {r["part"]: r["pairs"] for r in rows}


def run(spark: SparkSession, argv: list[str]) -> object:
    a = parser().parse_args(argv)
    engine = MemoryEngine(spark, a.store)
    store, log = engine.store, engine.memories
    if a.command == "ingest":
        return ingest(store, a)
    if a.command == "rebuild-cards":
        return rebuild(store, a)
    if a.command == "patterns":
        return mine(engine, a)
    if a.command == "merge":
        return {"merged": _merge(log, cut(log.state()), a)}
    if a.command == "reembed":
        state = cut(reembed(log.state(), a.dim, _made(a.embedder) if a.embedder else None))
        out = {"rows": state.count(), "merged": memories.greedy_merge(state, a.threshold).count() if a.merge_duplicates else 0}
        if a.apply:
            _merge(log, state, a) if a.merge_duplicates else log.replace(state)
        return out
    if a.command == "extract":
        return extract(engine, a)
    if a.command == "replay":
        return replay(engine, a)
    if a.command == "split":
        return split(spark, a)
    known = current(store, "cursors", CURSORS)
    if a.command == "status":
        return [tuple(r) for r in cursors.summary(known).collect()]
    store.publish("cursors", cut(cursors.reset(known, READERS[a.source].name if a.source else None)))
    return "done"


if __name__ == "__main__":
    print(run(build_session(), sys.argv[1:]))
