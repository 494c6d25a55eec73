import datetime as dt
import random

import pytest

from tidemark.llm import conversations as c

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "id long, session_id string, role string, content string, created_at timestamp, source_key string"


def rows(*items):
    return [(i, s, r, t, T0 + dt.timedelta(seconds=at) if at is not None else None, k) for i, s, r, t, at, k in items]


def reasons(spark, data):
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' as part", "'y' as doubled")
    return {r["session_id"]: r["reason"] for r in c.broken_sessions(df).collect()}


def test_reasons(spark):
    data = rows(
        (1, "ok", " User", "q", 0, None), (2, "ok", "ASSISTANT ", "a", 1, None), (3, "ok", "tool", "t", 2, None),
        (4, "norole", None, "q", 0, None), (5, "norole", "assistant", "a", 1, None),
        (6, "notime", "user", "q", None, None), (7, "notime", "assistant", "a", 1, None),
        (8, "blank", "user", "​﻿ \t\x00", 0, None), (9, "blank", "assistant", None, 1, None),
        (10, "starts", "assistant", "a", 0, None), (11, "starts", "user", "q", 1, None), (12, "starts", "assistant", "a", 2, None),
        (13, "twice", "user", "q", 0, None), (14, "twice", "user", "q", 1, None), (15, "twice", "assistant", "a", 2, None),
        (16, "ends", "user", "q", 0, None), (17, "ends", "assistant", "a", 1, None), (18, "ends", "user", "q", 2, None),
        (19, "copied", "user", "q", 0, "k1"), (20, "copied", "user", "q", 0, "k1"), (21, "copied", "assistant", "a", 1, "k2"),
        (22, "tie", "user", "q", 5, None), (23, "tie", "assistant", "a", 5, None),
        (24, "tools", "tool", "t", 0, None), (25, None, "user", "q", 0, None),
        (26, "later", "assistant", "a", 9, None), (27, "later", "user", "q", 1, None),
    )
    assert reasons(spark, data) == {"norole": "incomplete_row", "notime": "incomplete_row", "blank": "empty", "starts": "no_question", "twice": "no_reply", "ends": "no_reply", "tools": "empty"}


def test_empty_table(spark):
    assert reasons(spark, []) == {}
    assert c.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_a_channel_cut_into_many_partitions(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(600):
        s = "hot" if i % 2 else f"s{rng.randrange(40)}"
        data.append((i, s, rng.choice(["user", "assistant", "assistant"]), "x", T0 + dt.timedelta(seconds=rng.randrange(100_000)), None))
    df = spark.createDataFrame(data, SCHEMA)
    by = {}
    for r in sorted(data, key=lambda r: (r[4], r[0])):
        by.setdefault(r[1], []).append(r)
    got = c.ordered_rows(c.clean_rows(df), gap_seconds=600, partitions=13).collect()
    want = set()
    for s, items in by.items():
        part = pos = 0
        for k, r in enumerate(items):
            if k and (r[4] - items[k - 1][4]).total_seconds() > 600:
                part, pos = part + 1, 0
            want.add((s, r[0], part, pos, bool(pos and r[2] == "user" and items[k - 1][2] == "user")))
            pos += 1
    assert {(r["session_id"], r["id"], r["part"], r["position"], r["doubled"]) for r in got} == want


def test_order_and_gaps(spark):
    data = rows((1, "s", "user", "q", 0, None), (2, "s", "assistant", "a", 10, None), (3, "s", "user", "q", 5000, None), (4, "s", "assistant", "a", 5010, None))
    df = spark.createDataFrame(data, SCHEMA)
    assert [(r["part"], r["position"], r["id"]) for r in c.conversations(df).orderBy("id").collect()] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4)]
    assert [(r["part"], r["position"]) for r in c.conversations(df, gap_seconds=60).orderBy("id").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert c.calibrated_gap(df) == 40.0 and c.calibrated_gap(df.limit(0)) == float("inf")


def test_tool_rows_stay_in_the_conversation_and_are_not_judged(spark):
    data = rows(
        (1, "s", "system", "be brief", 0, None), (2, "s", "user", "q", 1, None), (3, "s", " Tool", "t", 2, None), (4, "s", "assistant", "a", 3, None), (5, "s", "tool", "t", 4, None),
        (6, "twice", "user", "q", 0, None), (7, "twice", "tool", "t", 1, None), (8, "twice", "user", "q", 2, None), (9, "twice", "assistant", "a", 3, None),
        (10, "open", "user", "q", 0, None), (11, "open", "tool", "t", 1, None),
    )
    df = spark.createDataFrame(data, SCHEMA)
    want = [("s", 0, "system", 1), ("s", 1, "user", 2), ("s", 2, "tool", 3), ("s", 3, "assistant", 4), ("s", 4, "tool", 5)]
    assert [(r["session_id"], r["position"], r["role"], r["id"]) for r in c.conversations(df).orderBy("id").collect()] == want
    assert [(r["position"], r["id"]) for r in c.conversations(df, roles=c.TALK).orderBy("id").collect()] == [(0, 2), (1, 4)]
    assert [(r["part"], r["position"], r["id"]) for r in c.conversations(df, gap_seconds=60).orderBy("id").collect()] == [(0, k, i) for _, k, _, i in want]


def test_tool_rows_over_many_partitions(spark):
    data = [(i, "hot", "user" if i in (0, 299) else "tool" if i < 300 else "assistant", "x", T0 + dt.timedelta(seconds=i), None) for i in range(320)]
    got = c.ordered_rows(c.clean_rows(spark.createDataFrame(data, SCHEMA)), partitions=13, roles=None).collect()
    assert sorted((r["id"], r["position"]) for r in got) == [(i, i) for i in range(320)]
    assert [r["id"] for r in got if r["doubled"]] == [299]


def test_pauses_over_full_hours_count(spark):
    slow = rows(*[(i, "slow", "user" if i % 2 == 0 else "assistant", "x", 4000 * i, None) for i in range(40)])
    df = spark.createDataFrame(slow, SCHEMA)
    assert c.calibrated_gap(df) == 16_000.0
    both = rows(*[(i, "s", "user" if i % 2 == 0 else "assistant", "x", 7200 * (i // 8) * 5 + 4000 * (i % 8), None) for i in range(80)])
    gap = c.calibrated_gap(spark.createDataFrame(both, SCHEMA))
    parts = {r["part"] for r in c.conversations(spark.createDataFrame(both, SCHEMA), gap_seconds=gap / 4).collect()}
    assert len(parts) == 10


def test_roles_are_inferred(spark):
    data = [(*r, tools) for r, tools in zip(rows(
        (1, "s", "Human", "q", 0, None), (2, "s", None, "a", 1, None), (3, "s", "user", "q", 2, None), (4, "s", " AI ", "a", 3, None), (5, "s", "", "q", 4, None),
        (6, "t", None, "first", 0, None), (7, "t", None, "ran it", 1, None), (8, "t", "critic", "hm", 2, None), (9, "t", None, " ", 3, None), (10, None, None, "x", 0, None)), [[], [], None, [], [], [], ["shell"], [], [], []], strict=True)]
    df = spark.createDataFrame(data, SCHEMA + ", tool_names array<string>")
    got = {r["id"]: (r["role"], r["told_by"]) for r in c.infer_roles(df).collect()}
    assert got == {1: ("user", "name"), 2: ("assistant", "turn"), 3: ("user", "written"), 4: ("assistant", "name"), 5: ("user", "turn"), 6: ("user", "turn"), 7: ("assistant", "tools"), 8: ("critic", "written")}
