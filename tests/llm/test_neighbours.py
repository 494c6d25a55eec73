import numpy as np

from tidemark.llm import neighbours as nb


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(float(s[i, j]), 5), ids[j]))[:k]
        out[ids[i]] = {ids[j] for j in order}
    return out


def recall(spark, x, **options):
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x.astype(np.float32), strict=True)], "id long, embedding array<float>")
    got = {}
    for r in nb.nearest(df, "id", "embedding", dim=x.shape[1], **options).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    want = brute(ids, x.astype(np.float32).astype(float), 5)
    assert all(len(v) == 5 and i not in v for i, v in got.items())
    return sum(len(got.get(i, set()) & w) for i, w in want.items()) / (5 * len(want))


def test_random_vectors(spark):
    assert recall(spark, np.random.default_rng(0).normal(size=(1500, 24)), file_size=200, candidates=150) > 0.9


def test_a_dense_third_is_divided_by_local_pivots(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1000, 16)), rng.normal(size=16) * 5 + rng.normal(size=(1000, 16)) * 0.3])
    assert recall(spark, x, file_size=100, candidates=150, postings=8) > 0.9


def test_copies_and_ties(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(i, a) for i in range(9)] + [(20, b), (21, [0.6, 0.8])], "id long, embedding array<float>")
    got = {}
    for r in nb.nearest(df, "id", "embedding", dim=2, k=3).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert sorted(got[8]) == [0, 1, 2] and sorted(got[0]) == [1, 2, 3]
    assert sorted(got[20]) == [0, 1, 21]


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (2, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").selectExpr("*", "1 as vec", "2 as n")
    assert {(r["id"], r["neighbour"]) for r in nb.nearest(df, "id", "embedding", dim=2).collect()} == {(1, 2), (2, 1)}
    assert nb.nearest(df.limit(0), "id", "embedding", dim=2).count() == 0
    assert nb.nearest(df.where("id = 1"), "id", "embedding", dim=2).count() == 0
