import pytest
from pyspark.sql import functions as F

from tests.test_memories import memory
from tests.test_sources import NAME, record, said, write
from tidemark.__main__ import run
from tidemark.functions.embedding import embed
from tidemark.operators.sampling import hash_sample
from tidemark.operators.store import SnapshotStore
from tidemark.schemas import MEMORIES


def test_commands(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    write(logs, "a.jsonl", [record("user", f"x sk-{'k' * 20}", None, f"u{i}", timestamp=f"2026-02-0{1 + i}T17:00:00Z") for i in range(3)])

    def go(*argv):
        return run(spark, ["--store", store, "--now", "2030-01-01 00:00:00", *argv])

    base = ("ingest", "--source", "nested", "--root", str(logs))
    assert go(*base, "--dry-run") == {"files": 1, "turns": 3, "masked": 3, "malformed": 0}
    assert go("status") == []
    assert go(*base)["new"] == 3 and go(*base)["files"] == 0
    assert go(*base, "--full")["new"] == 0
    assert go("status")[0][:2] == ("nested-log", 1)
    assert {d for d, _ in go("patterns")} == {"Observed repeated signal: source:nested log over time.", "Repeated project work tied to proj.", "Recurring branch context: main."}
    assert go("rebuild-cards", "2026-02-01", "2026-03-01") == {"cards": 2}
    assert go("reset-cursors") == "done" and go("status") == []
    write(logs, NAME, [said("user", "q"), said("assistant", "a")])
    assert go("ingest", "--source", "flat", "--root", str(logs), "--no-summaries")["new"] == 2


def test_merge_command(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.publish("memories", spark.createDataFrame([memory(1, [1, 0]), memory(2, [1, 0])], MEMORIES))
    argv = ["--store", str(tmp_path), "--now", "2026-03-01 00:00:00", "merge"]
    assert run(spark, argv) == {"merged": 1} and store.version("memories") == 1
    assert run(spark, [*argv, "--apply"]) == {"merged": 1}
    assert store.read("memories").where("superseded_by = 1").count() == 1


def test_provider_embeddings(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(embed(F.col("t"), lambda: lambda ts: [[float(len(t)), 0.0] for t in ts], 2)).collect()]
    assert got == [[1.0, 0.0], None, [1.0, 0.0]]
    with pytest.raises(Exception, match="gave 1 numbers"):
        df.select(embed(F.col("t"), lambda: lambda ts: [[1.0] for _ in ts], 2)).collect()


def test_samples_are_stable_and_bounded(spark):
    rows = spark.range(20_000)
    a = [r[0] for r in hash_sample(rows, ["id"], 100).collect()]
    assert len(a) == 100 and a == [r[0] for r in hash_sample(rows.repartition(7), ["id"], 100).collect()]
    assert hash_sample(spark.range(5), ["id"], 100).count() == 5


def make_provider():
    import json

    draft = {"narrative": "Shipped the parser and wrote all of its tests before noon.", "highlights": ["parser shipped"], "preferences": [{"content": "Prefers short functions.", "category": "coding_style", "confidence": 0.9, "evidence": "said so"}], "open_threads": []}
    return lambda messages: json.dumps(draft)


def test_extract_replay_split_and_reembed(spark, tmp_path):
    logs, store, log = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "log")
    logs.mkdir()
    write(logs, "a.jsonl", [record("user", f"line {i}", None, f"u{i}", timestamp="2026-02-01T17:00:00Z") for i in range(7)])

    def go(*argv):
        return run(spark, ["--store", store, "--now", "2030-01-01 00:00:00", *argv])

    go("ingest", "--source", "nested", "--root", str(logs))
    want = ("extract", "--provider", "tests.test_cli:make_provider", "--log", log)
    assert go(*want, "--dry-run") == {"prompts": 1}
    assert go(*want) == {"cards": 1, "narratives": 1, "inserted": 1}
    assert go(*want) == {"cards": 0, "narratives": 0}
    cards = SnapshotStore(spark, store).read("cards")
    assert cards.where("session_id is null").first()["narrative"].startswith("Shipped") and cards.count() == 2
    go("rebuild-cards")
    assert SnapshotStore(spark, store).read("cards").where("narrative is not null").count() == 1
    assert go("replay", "--log", log) == {"pairs": 1, "missing": 0, "preferences": 1, "refreshed": 1}
    assert sum(go("split", "--log", log, "--out", str(tmp_path / "out")).values()) == 1
    assert go("reembed", "--dim", "16", "--apply") == {"rows": 1, "merged": 0}
