import itertools
import math

import numpy as np
import pytest

from tests.conftest import at
from tidemark.config import DEFAULTS
from tidemark.operators import memories
from tidemark.schemas import MEMORIES
from tidemark.streaming.preferences import apply_writes

NOW = "2026-03-01 00:00:00"


def memory(i, vec, created="2026-03-01T00:00:00", valid=None, by=None, ns="operational", cat="other", factor=1.0, hits=0):
    return (i, f"m{i}", ns, cat, [float(x) for x in vec] if vec is not None else None, at(created), at(valid) if valid else None, by, hits, factor, None)


def table(spark, rows):
    return spark.createDataFrame(rows, MEMORIES)


def test_decay_of_equal_vectors(spark):
    ages = {1: "2026-03-01", 2: "2026-01-30", 3: "2025-09-02", 4: "2025-03-01"}
    got = memories.search(table(spark, [memory(i, [3, 4], d + "T00:00:00") for i, d in ages.items()]), [3.0, 4.0], NOW, top_k=4).collect()
    assert [r["id"] for r in got] == [1, 2, 3, 4]
    for r, days in zip(got, (0, 30, 180, 365), strict=True):
        assert abs(r["score"] - math.exp(-0.01 * days)) < 1e-6


def test_closed_memories_are_hidden_or_penalised(spark):
    df = table(spark, [memory(1, [1, 0]), memory(2, [1, 0], valid="2026-02-01T00:00:00")])
    assert [r["id"] for r in memories.search(df, [1.0, 0.0], NOW).collect()] == [1]
    both = {r["id"]: r["score"] for r in memories.search(df, [1.0, 0.0], NOW, include_closed=True).collect()}
    assert both[2] == pytest.approx(0.25)


def test_vectors_without_direction_have_no_score(spark):
    df = table(spark, [memory(1, [0, 0]), memory(2, None), memory(3, [1, 0, 0]), memory(4, [1, 0])])
    assert [r["id"] for r in memories.search(df, [1.0, 0.0], NOW).collect()] == [4]


def test_empty_filters_let_everything_pass(spark):
    df = table(spark, [memory(1, [1, 0]), memory(2, [1, 0], ns="reflective", cat="value")])
    assert memories.search(df, [1.0, 0.0], NOW, namespaces=[], categories=[]).count() == 2
    assert memories.search(df, [1.0, 0.0], NOW, namespaces=["reflective"]).count() == 1
    with pytest.raises(ValueError):
        memories.search(df, [1.0, 0.0], NOW, top_k=51)


def test_many_queries_equal_single_ones(spark):
    rng = np.random.default_rng(3)
    df = table(spark, [memory(i, rng.normal(size=8), f"2026-02-{1 + i % 27:02d}T00:00:00") for i in range(60)])
    queries = [(q, rng.normal(size=8).tolist()) for q in range(3)]
    got = memories.search_many(df, spark.createDataFrame(queries, "query_id long, vector array<double>"), NOW, top_k=4)
    for q, v in queries:
        one = [r["id"] for r in memories.search(df, v, NOW, top_k=4).collect()]
        assert [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == one


def brute_merge(vecs, threshold):
    ids, gone, out = sorted(vecs), set(), {}
    for i in ids:
        if i in gone:
            continue
        for j in ids:
            if j > i and j not in gone and float(np.dot(vecs[i], vecs[j])) >= threshold:
                gone.add(j)
                out[j] = i
    return out


def test_greedy_merge_is_no_connected_component(spark):
    c = math.cos
    vecs = {1: [1, 0], 2: [c(0.6), math.sin(0.6)], 3: [c(1.2), math.sin(1.2)]}
    got = {r["id"]: r["canonical"] for r in memories.greedy_merge(table(spark, [memory(i, v) for i, v in vecs.items()]), 0.8).collect()}
    assert got == {2: 1}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_merge_equals_the_scan(spark, seed):
    rng = np.random.default_rng(seed)
    vecs = {}
    for i in range(60):
        v = rng.normal(size=3).astype(np.float32)
        vecs[i] = (v / np.linalg.norm(v)).astype(np.float64)
    got = {r["id"]: r["canonical"] for r in memories.greedy_merge(table(spark, [memory(i, v) for i, v in vecs.items()]), 0.9).collect()}
    assert got == brute_merge({i: np.float32(v).astype(float) for i, v in vecs.items()}, 0.9)


WRITE = "write_id long, written_at timestamp, namespace string, category string, content string, embedding array<float>, supersede boolean"


def one_by_one(open_, writes):
    state = [(i, np.asarray(v, float) / np.linalg.norm(v)) for i, v in open_]
    events = []
    for w in sorted(writes, key=lambda w: (w[1], w[0])):
        v = np.asarray(w[5], float) / np.linalg.norm(w[5])
        best = max(((float(u @ v), -(i >= 0), i) for i, u in state), default=None, key=lambda x: x[0])
        if best and best[0] >= 0.8:
            events.append((w[0], "refreshed", best[2]))
            continue
        events.append((w[0], "inserted", -w[0]))
        if w[6] and best and best[0] >= 0.75:
            events.append((w[0], "superseded", best[2]))
            state = [s for s in state if s[0] != best[2]]
        state.append((-w[0], v))
    return sorted(events)


@pytest.mark.parametrize("seed", range(3))
def test_sequential_writes_equal_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    open_ = [(i, rng.normal(size=3)) for i in range(12)]
    writes = [(k, at(f"2026-02-{1 + k % 5:02d}T00:00:00"), "operational", "other", f"w{k}", rng.normal(size=3).astype(np.float32).tolist(), bool(k % 2)) for k in range(1, 40)]
    got = memories.write_events(table(spark, [memory(i, np.float32(v)) for i, v in open_]), spark.createDataFrame(writes, WRITE))
    assert sorted((r["seq"], r["event"], r["id"]) for r in got.collect()) == one_by_one([(i, np.float32(v)) for i, v in open_], writes)


@pytest.mark.parametrize(("sim", "supersede", "event"), [(0.81, False, "refreshed"), (0.79, True, "superseded"), (0.79, False, "inserted"), (0.74, True, "inserted")])
def test_bands_of_a_write(spark, sim, supersede, event):
    w = spark.createDataFrame([(1, at("2026-03-02T00:00:00"), "operational", "other", "new", [sim, math.sqrt(1 - sim * sim)], supersede)], WRITE)
    after = {r["id"]: r for r in apply_writes(table(spark, [memory(10, [1, 0], "2026-01-01T00:00:00")]), w).collect()}
    old = after[10]
    assert old["created_at"] == at("2026-01-01T00:00:00")
    if event == "refreshed":
        assert len(after) == 1 and old["access_count"] == 1 and old["valid_at"] is None
    else:
        assert set(after) == {10, 11} and after[11]["content"] == "new"
        assert (old["superseded_by"] == 11 and old["valid_at"] is not None) if event == "superseded" else old["valid_at"] is None


def test_refresh_reopens_and_keeps_the_pointer(spark):
    df = table(spark, [memory(1, [1, 0], valid="2026-02-01T00:00:00", by=2), memory(2, [0, 1])])
    events = spark.createDataFrame([("refreshed", at("2026-03-01T00:00:00"), 1, 1, None, None, None, None, None, None)], memories.EVENTS)
    row = memories.fold(df, events).where("id = 1").first()
    assert row["valid_at"] is None and row["superseded_by"] == 2 and row["access_count"] == 1


def test_other_namespaces_and_categories_do_not_meet(spark):
    w = spark.createDataFrame([(1, at("2026-03-02T00:00:00"), ns, cat, "x", [1.0, 0.0], True) for ns, cat in itertools.islice([("operational", "schedule")], 1)], WRITE)
    got = memories.write_events(table(spark, [memory(10, [1, 0])]), w).collect()
    assert [r["event"] for r in got] == ["inserted"]


def test_chains_end_and_cycles_stop(spark):
    df = table(spark, [memory(i, [1, 0], valid="2026-02-01T00:00:00", by=i + 1) for i in range(1, 9)] + [memory(9, [1, 0]), memory(20, [1, 0], by=21), memory(21, [1, 0], by=20)])
    got = {r["id"]: (r["last_id"], r["steps"]) for r in memories.supersession_chains(spark, df).collect()}
    assert all(got[i] == (9, 9 - i) for i in range(1, 9))


def test_long_chains_and_cycles_reach_their_end(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1001), (2000, 2000)]
    got = {r["id"]: (r["last_id"], r["steps"]) for r in memories.supersession_chains(spark, spark.createDataFrame(rows, "id long, superseded_by long")).collect()}
    assert got == {i: (300, 300 - i) for i in range(300)} | {1000: (1002, 2), 1001: (1002, 1), 1002: (1001, 1), 2000: (2000, 0)}


def test_merge_closes_and_counts(spark):
    df = table(spark, [memory(1, [1, 0]), memory(2, [1, 0]), memory(3, [0, 1])])
    after = {r["id"]: r for r in memories.apply_merge(df, memories.greedy_merge(df, 0.9), NOW).collect()}
    assert after[2]["superseded_by"] == 1 and after[2]["valid_at"] is not None
    assert after[1]["access_count"] == 1 and after[3]["valid_at"] is None


def test_defaults():
    assert (DEFAULTS.decay_per_day, DEFAULTS.dedup_threshold, DEFAULTS.conflict_threshold, DEFAULTS.closed_penalty) == (0.01, 0.80, 0.75, 0.25)
