import random
import re

import pytest

from tidemark.llm import leakage
from tidemark.llm.textscan import folded, window_hashes, winnow

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "rt", "x", "ss", "pel")]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(docs, items, k):
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    found = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs for i, g in found if g & grams(t)}


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(passage(rng, 30))) for i in range(20)]
    docs = []
    for d in range(120):
        words = passage(rng, rng.randrange(60))
        src = rng.choice(items)[1].split()
        n = rng.choice([6, 10, 11, 12, 13, 20])
        at = rng.randrange(len(src) - n)
        bit = src[at : at + n]
        if rng.random() < 0.3:
            bit[n // 2] = "changed"
        docs.append((d, rng.choice([" ", "  ", "-", "\n"]).join([*words, *bit, *passage(rng, 5)]).upper()))
    docs += [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    it = spark.createDataFrame([*items, (900, None), (901, "too few words"), (None, "x")], "item_id long, item_text string")
    for block in (4_000_000, 300):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "item_text", block_chars=block).collect()}
        assert got == brute(docs, items, 12)
    assert leakage.leaks(df.limit(0), "doc_id", "text", it, "item_id", "item_text").count() == 0
    assert leakage.leaks(df, "doc_id", "text", it.limit(0), "item_id", "item_text").count() == 0


def test_edits(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november"
    w = item.split()
    texts = {1: w, 2: [*w[:6], "other", *w[7:]], 3: [*w[:6], *w[7:]], 4: [*w[:6], "added", *w[6:]], 5: [*w[:3], "x", *w[4:7], "y", *w[8:]], 6: w[:5]}
    df = spark.createDataFrame([(d, "pad words " + " ".join(t) + " pad") for d, t in texts.items()], "doc_id long, text string")
    it = spark.createDataFrame([(1, item)], "item_id long, item_text string")
    got = {e: {r["doc_id"] for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "item_text", q=8, edits=e).collect()} for e in (0, 1, 2)}
    assert got == {0: {1}, 1: {1, 2, 3, 4}, 2: {1, 2, 3, 4, 5}}


def test_alignment():
    a = list("abcdefgh")
    assert leakage.longest_aligned(a, list("xxabcdefghxx"), 0) == 8
    assert leakage.longest_aligned(a, list("abcXefgh"), 0) == 4
    assert leakage.longest_aligned(a, list("abcXefgh"), 1) == 8
    assert leakage.longest_aligned(a, list("abcefgh"), 1) == 8
    assert leakage.longest_aligned(a, list("abcdYefgh"), 1) == 8


def test_folding_across_chunks():
    import tidemark.llm.textscan as ts

    old, ts.CHUNK = ts.CHUNK, 7
    try:
        t = "  Ab_c--D é1 İx 中文 \n\t z "
        assert "".join(map(chr, folded(t))) == " ab c d é1 ix 中文 z "
    finally:
        ts.CHUNK = old
    assert "".join(map(chr, folded(""))) == " "


def test_winnowing_promises_a_common_mark():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        z = rng.integers(97, 105, 120).astype(np.uint32)
        a = np.concatenate([rng.integers(97, 105, 50).astype(np.uint32), z])
        b = np.concatenate([z, rng.integers(97, 105, 80).astype(np.uint32)])
        ha, hb = window_hashes(a, 81), window_hashes(b, 81)
        assert set(ha[winnow(ha, 40)]) & set(hb[winnow(hb, 40)])
    flat = window_hashes(np.full(5000, 97, np.uint32), 81)
    assert len(winnow(flat, 40)) == 2


@pytest.mark.parametrize("size", [1, 30, 60, 400])
def test_added_words_of_any_length(spark, size):
    words = "alder birch cedar hazel maple olive pecan rowan larch aspen beech holly".split()
    text = " ".join([*["before"] * 30, *words[:4], "x" * size, *words[4:8], "y" * size, *words[8:], *["after"] * 30])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, item_text string")
    got = leakage.leaks(docs, "doc_id", "text", items, "item_id", "item_text", q=8, edits=2).collect()
    assert [tuple(r) for r in got] == [(1, 7, 12)]
