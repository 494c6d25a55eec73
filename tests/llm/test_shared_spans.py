import random

import pytest

from tidemark.llm import shared_spans as ss


def brute(docs, k):
    grams = {d: {t[i : i + k] for i in range(len(t) - k + 1)} for d, t in docs if t}
    ids = sorted(grams)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if grams[a] & grams[b]}


def corpus(seed):
    rng = random.Random(seed)

    def noise(n, letters="abcdefghij é中"):
        return "".join(rng.choice(letters) for _ in range(n))

    pool = [noise(rng.randrange(250, 700)) for _ in range(8)] + ["z" * 500, "ab" * 300]
    docs = []
    for d in range(90):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool)
            n = rng.choice([200, 280, 299, 300, 301, 350, 600])
            at = rng.randrange(max(1, len(p) - n + 1))
            parts += [noise(rng.randrange(40)), p[at : at + n]]
        docs.append((d, "".join(parts)))
    docs += [(200, docs[0][1]), (201, docs[0][1]), (202, None), (203, ""), (204, "short"), (205, docs[3][1] + "x")]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([*docs, docs[5]], "doc_id long, text string").selectExpr("*", "1 as doc", "'x' as hub")
    got = {tuple(r) for r in ss.shared_spans(df, "doc_id", "text").collect()}
    assert got == brute(docs, 300)


def test_amounts_equal_brute_force(spark):
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in ss.shared_amounts(df, "doc_id", "text").collect()}
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - 299):
            where.setdefault(t[i : i + 300], set()).add(d)
    for d, t in docs:
        covered = set()
        for i in range(len(t or "") - 299):
            if len(where[t[i : i + 300]]) > 1:
                covered.update(range(i, i + 300))
        assert got[d] == (len(t or ""), len(covered)), d


def test_lines(spark):
    df = spark.createDataFrame([(2, "b\n a  x \nb"), (1, "a x\né\n"), (3, None), (4, ""), (5, "\n\n")], "doc_id long, text string").selectExpr("*", "1 as n", "2 as line")
    got = {tuple(r) for r in ss.line_duplicates(df, "doc_id", "text").collect()}
    assert got == {(2, 2, 2, 6, 1, 1), (2, 3, 9, 1, 2, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ss.shared_spans(df, "doc_id", "text").count() == ss.line_duplicates(df, "doc_id", "text").count() == ss.shared_amounts(df, "doc_id", "text").count() == 0


def test_later_lines_are_removed_and_offsets_kept(spark):
    rows = [(1, "one\ntwo \n\nthree"), (2, "two\nfour\n\none"), (3, None), (4, ""), (5, "one\n one"), (6, "four\nfive")]
    df = spark.createDataFrame(rows, "id long, body string").selectExpr("*", "1 as kept")
    got = {r["doc_id"]: (r["text_kept"], [tuple(x) for x in r["kept"]]) for r in ss.without_later_lines(df, "id", "body").collect()}
    assert got == {1: ("one\ntwo \n\nthree", [(0, 3), (4, 4), (9, 0), (10, 5)]), 2: ("four\n", [(4, 4), (9, 0)]), 3: (None, []), 4: ("", [(0, 0)]), 5: ("", []), 6: ("five", [(5, 4)])}
    texts = dict(rows)
    assert all(t is None or t == "\n".join(texts[d][s : s + n] for s, n in spans) for d, (t, spans) in got.items())
