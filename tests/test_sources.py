import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import cursors, flat_log, lines, nested_log


def record(kind="assistant", text="hi", mid="m1", uuid="u1", **more):
    message = {"role": kind, "content": text if isinstance(text, (str, list)) else [], "usage": {"output_tokens": 7}}
    if mid:
        message["id"] = mid
    return {"type": kind, "uuid": uuid, "sessionId": "s", "timestamp": "2026-02-01T10:00:00Z", "cwd": "/home/x/proj", "gitBranch": "main", "message": message} | more


def write(folder, name, rows):
    p = folder / name
    p.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return p


def nested(spark, folder, **options):
    found, metrics = nested_log.parse(lines.read_lines(lines.discover(spark, str(folder)), hot_after=options.pop("hot_after", None)), **options)
    return found.orderBy("line_no").collect(), metrics.first()


def block(t):
    return [{"type": "text", "text": t}]


def test_adjacent_records_of_one_message_are_one_turn(spark, tmp_path):
    write(tmp_path, "a.jsonl", [record(text=block("one")), "", record(text=block("two"), uuid="u2"), '["no object"]', record(text=[{"type": "tool_use", "name": "read"}], uuid="u3")])
    got, m = nested(spark, tmp_path)
    assert len(got) == 1
    assert got[0]["text"] == "one\ntwo\n[tool:read]" and got[0]["tool_names"] == ["read"]
    assert got[0]["token_count"] == 7 and got[0]["token_source"] == "provider"
    assert got[0]["source_key"] == "nested-log:u1" and got[0]["project"] == "proj"
    assert m["malformed_lines"] == 1 and m["lines_read"] == 5


def test_another_record_parts_a_message(spark, tmp_path):
    write(tmp_path, "a.jsonl", [record(text=block("one")), record("user", "hello", None, "u9"), record(text=block("two"), uuid="u2")])
    got, _ = nested(spark, tmp_path)
    assert [r["text"] for r in got] == ["one", "hello", "two"]


def test_a_group_is_lost_with_its_first_record(spark, tmp_path):
    write(tmp_path, "a.jsonl", [record(text=[{"type": "thinking", "thinking": "hm"}]), record(text=block("two"), uuid="u2")])
    assert nested(spark, tmp_path)[0] == []
    assert [r["text"] for r in nested(spark, tmp_path, thinking=True)[0]] == ["[thinking] hm\ntwo"]


def test_a_malformed_line_ends_the_file(spark, tmp_path):
    rows = [record("user", "eins ü", None, f"u{i}") for i in range(3)]
    p = write(tmp_path, "a.jsonl", [*rows, '{"broken', record("user", "late", None, "u8")])
    got, m = nested(spark, tmp_path)
    assert len(got) == 3
    assert m["bytes_read"] == sum(len(json.dumps(r).encode()) + 1 for r in rows) and m["malformed_lines"] == 1
    cursor = spark.createDataFrame([(lines.discover(spark, str(tmp_path)).first()["path"], m["bytes_read"])], "path string, bytes_read long")
    p.write_text("".join(json.dumps(r) + "\n" for r in [*rows, record("user", "late", None, "u8")]))
    rest, again = nested_log.parse(lines.read_lines(lines.discover(spark, str(tmp_path)), cursor))
    assert [r["text"] for r in rest.collect()] == ["late"]
    assert again.first()["bytes_read"] == p.stat().st_size and again.first()["restarted"] is False


def test_a_cursor_beyond_the_file_restarts(spark, tmp_path):
    write(tmp_path, "a.jsonl", [record("user", "x", None)])
    path = lines.discover(spark, str(tmp_path)).first()["path"]
    found, m = nested_log.parse(lines.read_lines(lines.discover(spark, str(tmp_path)), spark.createDataFrame([(path, 10**6)], "path string, bytes_read long")))
    assert found.count() == 1 and m.first()["restarted"] is True


def test_a_hot_file_holds_its_last_group_back(spark, tmp_path):
    first = record("user", "x", None, "u0")
    write(tmp_path, "a.jsonl", [first, record(text=block("one"))])
    got, m = nested(spark, tmp_path, hot_after="2000-01-01")
    assert [r["text"] for r in got] == ["x"] and m["bytes_read"] == len(json.dumps(first)) + 1


@pytest.mark.parametrize("more", [{"isMeta": True}, {"isSidechain": True}, {"type": "summary"}, {"timestamp": "yesterday"}])
def test_records_that_are_no_turn(spark, tmp_path, more):
    write(tmp_path, "a.jsonl", [record("user", "x", None) | more])
    got, m = nested(spark, tmp_path)
    assert got == [] and m["lines_skipped"] == 1


def test_masks_are_counted_with_the_first_record_again(spark, tmp_path):
    key = "sk-" + "a" * 20
    write(tmp_path, "a.jsonl", [record(text=block(key)), record(text=block("two"), uuid="u2")])
    assert nested(spark, tmp_path)[0][0]["redactions"] == 2
    assert nested(spark, tmp_path, strict_parity=False)[0][0]["redactions"] == 1


def test_nul_is_removed(spark, tmp_path):
    write(tmp_path, "a.jsonl", [record("user", "a\0b", None)])
    assert nested(spark, tmp_path)[0][0]["text"] == "ab"


def envelope(kind, ts="2026-02-01T10:00:00Z", top="response_item", **payload):
    return {"timestamp": ts, "type": top, "payload": {"type": kind} | payload}


def said(role, text, **more):
    return envelope("message", role=role, content=[{"type": "input_text", "text": text}], **more)


def flat(spark, folder):
    found, m = flat_log.parse(lines.read_lines(lines.discover(spark, str(folder))))
    return found.orderBy("line_no").collect(), m.first()


NAME = "rollout-2026-02-01T10-00-00-0123abcd-0123-0123-0123-0123456789ab.jsonl"


def test_directory_is_carried_and_tools_wait_for_the_answer(spark, tmp_path):
    rows = [envelope("", top="turn_context", cwd="/w/app"), envelope("function_call", name="shell"), envelope("custom_tool_call", tool_name="patch"), said("user", "q"), said("assistant", "a"), said("developer", "no"), envelope("user_message", message="q"), envelope("function_call", name="late")]
    write(tmp_path, NAME, rows)
    got, m = flat(spark, tmp_path)
    assert [(r["role"], r["text"]) for r in got] == [("user", "q"), ("assistant", "a\n[tool:shell]\n[tool:patch]")]
    assert got[0]["tool_names"] == [] and got[1]["tool_names"] == ["shell", "patch"]
    assert {r["project"] for r in got} == {"app"} and got[0]["session_id"].startswith("0123abcd")
    assert m["lines_skipped"] == 2


def test_equal_identities_get_numbers(spark, tmp_path):
    write(tmp_path, NAME, [said("user", "a"), said("user", "b")])
    got, _ = flat(spark, tmp_path)
    assert len({r["source_key"] for r in got}) == 2


def test_rollouts_only(spark, tmp_path):
    for d in ("sessions/2026/02", "archived_sessions", "other"):
        (tmp_path / d).mkdir(parents=True)
    for p in (f"sessions/2026/02/{NAME}", f"archived_sessions/{NAME}", "sessions/notes.jsonl", NAME):
        write(tmp_path, p, ["{}"])
    paths = [r["path"] for r in lines.discover(spark, str(tmp_path)).where(lines.is_rollout(F.col("path"))).select("path").collect()]
    assert len(paths) == 3


def test_cursors_add_up(spark, tmp_path):
    write(tmp_path, "a.jsonl", [record("user", "x", None)])
    files = lines.discover(spark, str(tmp_path))
    found, m = nested_log.parse(lines.read_lines(files))
    empty = spark.createDataFrame([], "source string, path string, bytes_read long, turns_ingested int, last_uuid string, updated_at timestamp")
    one = cursors.advance(empty, m, found, "nested-log", "2026-02-01")
    two = cursors.advance(one, m, found, "nested-log", "2026-02-02")
    assert two.first()["turns_ingested"] == 2 and cursors.summary(two).first()["files"] == 1
    assert cursors.unread(files, one).count() == 0 and cursors.unread(files, one, full=True).count() == 1
    assert cursors.reset(two, "nested-log").count() == 0
    assert os.listdir(tmp_path)
