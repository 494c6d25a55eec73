import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing


@pytest.mark.parametrize("seed", range(5))
def test_plans_hold_every_size_within_capacity(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(30)}
    groups = packing.plan(histogram, (25, 50, 100))
    got = {}
    for g in groups:
        assert 0 < g.used <= g.capacity and g.capacity in (25, 50, 100)
        for s, n in g.contents:
            got[s] = got.get(s, 0) + n * g.count
    assert got == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(g.capacity * g.count for g in groups) <= 1.25 * total + 100


def test_equal_sizes_and_small_containers():
    assert sorted((g.capacity, g.count, g.contents) for g in packing.plan({50: 5}, (100,))) == [(100, 1, ((50, 1),)), (100, 2, ((50, 2),))]
    assert {g.capacity for g in packing.plan({10: 1}, (16, 64))} == {16}
    assert packing.plan({}, (10,)) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, (10,))


def test_rows(spark):
    texts = [(1, "word " * 3000), (2, None), (3, ""), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, "<|endoftext|>")] + [(100 + i, "some text " * (i % 90 + 1)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as size", "'x' as container")
    out = packing.pack(df, "doc_id", "text", capacities=(256, 512)).cache()
    per = out.groupBy("container").agg(F.sum("size").alias("u"), F.first("capacity").alias("c"))
    assert per.where("u > c").count() == 0
    used, room = per.agg(F.sum("u"), F.sum("c")).first()
    assert used / room > 0.97
    counts = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert counts[2] == counts[3] == 0 and counts[6] > 1
    sums = {r["doc_id"]: (r["n"], r["s"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()}
    assert sums[1] == (-(-counts[1] // 512), counts[1]) and 2 not in sums and sums[5] == (2, 2 * counts[5])
    assert all(n == 1 for d, (n, _) in sums.items() if d not in (1, 5))
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def cost(groups):
    return sum(g.capacity * g.count for g in groups)


@pytest.mark.parametrize(
    ("histogram", "least"),
    [({1500: 10}, 15_360), ({1000: 10}, 10_240), ({600: 7}, 5_120), ({1030: 5}, 7_680), ({2048: 3, 500: 1}, 6_656), ({1300: 4, 700: 4}, 8_192), ({1100: 6, 430: 6}, 9_216)],
)
def test_sizes_for_which_the_capacity_matters(histogram, least):
    assert cost(packing.plan(histogram, (512, 1024, 1536, 2048))) <= least <= cost(packing.plan(histogram, (2048,)))


def test_a_hot_size_is_ranked_in_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 40)
    df = spark.createDataFrame([(i, "same words in each") for i in range(500)] + [(1000 + i, "other words " * 5) for i in range(60)], "doc_id long, text string")
    out = packing.pack(df, "doc_id", "text", capacities=(64, 128)).cache()
    per = out.groupBy("container").agg(F.sum("size").alias("u"), F.first("capacity").alias("c"))
    assert out.count() == 560 and per.where("u > c").count() == 0 and per.agg(F.sum("u") / F.sum("c")).first()[0] > 0.9
