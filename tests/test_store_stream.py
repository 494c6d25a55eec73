import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_sources import record, write
from tidemark.api import MemoryEngine
from tidemark.config import Settings
from tidemark.operators.store import SnapshotStore
from tidemark.sources import lines, nested_log
from tidemark.streaming.deliveries import keep_first
from tidemark.streaming.ingest import ingest_stream, store_batch


def test_versions(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path))
    assert s.version("t") == 0
    s.publish("t", spark.range(3))
    s.publish("t", s.read("t").union(spark.range(1)))
    assert s.version("t") == 2 and s.read("t").count() == 4 and s.read("t", 1).count() == 3


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, "a.jsonl", [record("user", f"x{i}", None, f"u{i}", timestamp=f"2026-02-0{1 + i % 3}T10:00:00Z") for i in range(8)])
    store = SnapshotStore(spark, str(tmp_path / "store"))
    ingest_stream(spark, str(logs), store, str(tmp_path / "c")).awaitTermination()
    assert store.read("turns").count() == 8 and store.read("cards").where("session_id is null").count() == 3
    write(logs, "b.jsonl", [record("user", "x0", None, "u0"), record("user", "new", None, "u99", timestamp="2026-02-01T11:00:00Z")])
    ingest_stream(spark, str(logs), store, str(tmp_path / "c")).awaitTermination()
    assert store.read("turns").count() == 9
    card = store.read("cards").where("period = '2026-02-01' and session_id is null").first()
    assert card["summary"].startswith("4 turns")
    whole = SnapshotStore(spark, str(tmp_path / "batch"))
    found, _ = nested_log.parse(lines.read_lines(lines.discover(spark, str(logs))))
    assert store_batch(whole, found, "UTC") == 9
    assert store_batch(whole, found, "UTC") == 0

    def state(s):
        return sorted(map(tuple, s.read("turns").select("source_key", "content").collect())), sorted(json.dumps(r.asDict()) for r in s.read("cards").select("session_id", "period", "summary", "developer_behavior_facts", "token_count").collect())

    assert state(whole) == state(store)


def test_redelivered_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.read.parquet(f"{SMALL}/parsed_turns.parquet").select("delivery_id", "source_key", "arrived_at")
    rows.where("delivery_id % 2 = 0").coalesce(1).write.parquet(f"{src}/1")
    store = SnapshotStore(spark, str(tmp_path / "s"))

    def go():
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(src)
        keep_first(stream, store, "seen", str(tmp_path / "c"), key="source_key", arrived="arrived_at", row_id="delivery_id").awaitTermination()

    go()
    rows.where("delivery_id % 2 = 1").coalesce(1).write.parquet(f"{src}/2")
    go()
    assert store.read("seen").count() == rows.select("source_key").distinct().count()


@pytest.fixture
def engine(spark, tmp_path):
    return MemoryEngine(spark, str(tmp_path / "e"), Settings(embedding_dim=32))


def test_engine(spark, engine):
    now = "2026-03-01 00:00:00"
    t = dt.datetime(2026, 2, 1, 10)
    turn_cols = "session_id string, role string, content string, tool string, token_count int, created_at timestamp, source_key string, project string, git_branch string, tool_names array<string>"
    rows = spark.createDataFrame([("s", "user", f"c{i}", "log", 1, t + dt.timedelta(minutes=i), f"k{i}", "p", None, []) for i in range(15)], turn_cols)
    assert engine.append_many(rows) == 15 and engine.append_many(rows) == 0
    assert engine.read_buffer("s").count() == 12 and engine.evicted("s").count() == 3
    found, total = engine.list_turns_between("2026-02-01", "2026-02-02", 5)
    assert found.count() == 5 and total == 15
    writes = spark.createDataFrame([(1, t, "operational", "other", "prefers tabs over spaces", False, False), (2, t, "operational", "other", "prefers tabs over spaces", False, False), (3, t, "operational", "other", "walks at noon", False, False)], "write_id long, written_at timestamp, namespace string, category string, content string, supersede boolean, confirmed boolean")
    engine.upsert_preferences(writes)
    assert engine.list_memories(now).count() == 2
    hit = engine.temporal_query("tabs or spaces", now, top_k=1).first()
    assert hit["content"] == "prefers tabs over spaces"
    assert engine.table("memories").where("content like 'prefers%'").first()["access_count"] == 2
    with pytest.raises(ValueError):
        engine.upsert_preferences(writes.withColumn("namespace", F.lit("reflective")))
    day = dt.date(2026, 2, 1)
    cand = spark.createDataFrame([("works on the parser", [(day, "a", "1"), (day, "b", "2"), (dt.date(2026, 2, 2), "c", "3")], ["t2"], 0.65)], "description string, supporting_evidence array<struct<source_date: date, summary: string, source_id: string>>, contexts array<string>, confidence double")
    engine.propose_pattern(cand, now)
    cid = engine.list_patterns().first()["id"]
    decision = spark.createDataFrame([(cid, "confirm", None, "ok")], "candidate_id long, decision string, confirmed_content string, note string")
    engine.resolve_patterns(decision, now)
    engine.resolve_patterns(decision, now)
    assert engine.list_patterns().count() == 0 and engine.list_patterns("confirmed").count() == 1
    assert engine.list_memories(now, namespaces=["reflective"]).count() == 1
    engine.write_summary(spark.createDataFrame([(1, None, "2026-03-01", "s", ["f"], t, t)], "id long, session_id string, period string, summary string, developer_behavior_facts array<string>, created_at timestamp, updated_at timestamp"))
    r = engine.daily_review("2026-03-01").first()
    assert r["period"] == "2026-03-01" and r["card"]["summary"] == "s" and len(r["reflective"]) == 1
    assert engine.health()["tables"]["turns"] == 15
    engine.archive(hit["id"], now)
    assert engine.list_memories(now, include_closed=False).count() == 2


def test_what_is_appended_to_a_log_reaches_the_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    p = write(logs, "a.jsonl", [record("user", "one", None, "u1"), record("assistant", "half", "m1", "u2")])
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def go(hot):
        ingest_stream(spark, str(logs), store, str(tmp_path / "c"), hot_seconds=hot).awaitTermination()
        return sorted(r["content"] for r in store.read("turns").select("content").collect())

    assert go(3600) == ["one"]  # the group at the end may still grow
    with p.open("a") as f:
        f.write(json.dumps(record("assistant", "more", "m1", "u3")) + "\n")
    assert go(0) == ["half\nmore", "one"]
    engine = MemoryEngine(spark, str(tmp_path / "store"))
    assert engine.list_summaries().count() == 1 and engine.daily_review("2026-02-01").first()["card"] is not None
    assert engine.get_summary("2026-02-01").first()["generated_by"] == "rule"


def test_an_unfinished_version_is_no_version(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path))
    s.publish("t", spark.range(3))
    broken = tmp_path / "t" / "v2"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"torn")
    assert s.version("t") == 1 and s.read("t").count() == 3
    s.append("t", spark.range(2), "batch/7")
    s.append("t", spark.range(2), "batch/7")
    assert s.read("t").count() == 5 and s.version("t") == 2 and s.has_tag("t", "batch/7")
    s.publish("t", s.read("t"))
    s.publish("t", s.read("t"))
    s.vacuum("t", keep=1)
    assert s.read("t").count() == 5 and s.increments("t") == 0
