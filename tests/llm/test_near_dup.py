import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_dup
from tidemark.operators.graph import components


def brute(rows, t):
    sets = [(i, frozenset(re.findall(r"[^\W_]+", (x or "").lower()))) for i, x in rows]
    return {(min(i, j), max(i, j)) for a, (i, s) in enumerate(sets) for j, u in sets[a + 1 :] if s and u and i != j and len(s & u) >= t * len(s | u) - 1e-9}


def texts(seed, n=120):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(20)] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        rng.shuffle(words)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_pairs_equal_brute_force(spark, seed):
    rows = [*texts(seed), (500, None), (501, ""), (502, "!?_"), (503, "Über-maß x"), (504, "ÜBER maß X"), (505, "same words here"), (506, "here same words"), (506, "here same words")]
    df = spark.createDataFrame(rows, "id long, content string").selectExpr("*", "1 as cls", "'x' as words")
    got = {tuple(r) for r in near_dup.similar_pairs(df, "id", "content").collect()}
    assert got == brute(list(dict(rows).items()), 0.7)


def test_a_hot_bucket_keeps_its_links(spark):
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join([*common, f"x{i}", f"y{i % 7}"])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, content string")
    assert {tuple(r) for r in near_dup.similar_pairs(df, "id", "content").collect()} == brute(rows, 0.7)
    g = near_dup.groups(df, "id", "content", threshold=0.8).collect()
    assert len(g) == 80 and {r["group_id"] for r in g} == {0}


def test_groups_have_a_row_for_each_record(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, "other words"), (4, None)], "id long, content string")
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in near_dup.groups(df, "id", "content").collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0)}
    assert near_dup.groups(df.limit(0), "id", "content").count() == near_dup.similar_pairs(df.limit(0), "id", "content").count() == 0


def expected(rows, t):
    sets = {i: frozenset(re.findall(r"[^\W_]+", x.lower())) for i, x in rows}
    near = {i: {sets[j] for j in sets if sets[j] != s and len(s & sets[j]) >= t * len(s | sets[j]) - 1e-9} for i, s in sets.items()}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, s in sets.items():
            low = min(group[j] for j in sets if sets[j] == s or sets[j] in near[i])
            changed |= low < group[i]
            group[i] = min(group[i], low)
    return {i: (group[i], len(near[i])) for i in sets}


@pytest.mark.parametrize("block", [512, 20])
def test_groups_count_every_link_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(5)
    rows = []
    for i in range(240):
        words = [f"c{k}" for k in range(24)]
        for _ in range(3):
            words[rng.randrange(24)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in near_dup.groups(spark.createDataFrame(rows, "id long, content string"), "id", "content", threshold=0.7).collect()}
    assert got == expected(rows, 0.7)


@pytest.mark.parametrize("t", [0.4, 0.7, 0.8])
def test_groups_of_short_and_long_texts(spark, t):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        n = rng.choice([1, 2, 3, 4, 60, 64, 66, 80])
        start = rng.randrange(8)
        rows.append((i, " ".join(f"w{k}" for k in range(start, start + n) if n < 5 or rng.random() < 0.95)))
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in near_dup.groups(spark.createDataFrame(rows, "id long, content string"), "id", "content", threshold=t).collect()}
    assert got == expected(rows, t)


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    sign = near_dup.OnePermutation(2000)
    a = rng.integers(-(2**62), 2**62, 30)
    b = np.concatenate([a[:24], rng.integers(-(2**62), 2**62, 6)])
    assert abs(float((sign(a) == sign(b)).mean()) - 24 / 36) < 0.2
    assert (sign(a) == sign(a[::-1])).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 40} == {0} and {v for k, v in got.items() if k >= 100} == {100} and len(got) == 101
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert F


def test_no_pair_of_a_large_template_is_lost(spark):
    """Texts of one template: all share 28 words, and two by two five more; only those two are similar enough."""
    rows = []
    for i in range(1500):
        common = [f"c{k}" for k in range(28)] + [f"p{i}x{k}" for k in range(5)]
        rows += [(2 * i, " ".join([*common, *(f"a{i}x{k}" for k in range(7))])), (2 * i + 1, " ".join([*common, *(f"b{i}x{k}" for k in range(7))]))]
    df = spark.createDataFrame(rows, "id long, content string")
    assert {tuple(r) for r in near_dup.similar_pairs(df, "id", "content").collect()} == {(2 * i, 2 * i + 1) for i in range(1500)}
    got = near_dup.groups(df, "id", "content", threshold=0.7).collect()
    assert len(got) == 3000 and {(r["group_id"], r["n_links"]) for r in got} == {(2 * i, 1) for i in range(1500)}
