import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, text, timez, validation, vectors
from tidemark.functions.redaction import redact
from tidemark.operators import cache, dataset, evaluation, extraction

KEY = "A1b2C3d4" * 5


@pytest.mark.parametrize(
    ("given", "masked", "n"),
    [
        ("x sk-" + KEY, "x [redacted:openai-key]", 1),
        ("sk-ant-" + KEY, "[redacted:openai-key]", 1),
        ("ghp_" + KEY, "[redacted:github-token]", 1),
        ("xoxb-1234567890ab", "[redacted:slack-token]", 1),
        ("AIza" + KEY, "[redacted:google-key]", 1),
        ("AKIA" + "A" * 16, "[redacted:aws-access-key]", 1),
        ("rk_live_" + KEY, "[redacted:stripe-key]", 1),
        (f"eyJ{KEY}.{KEY}.{KEY}", "[redacted:jwt]", 1),
        ("-----BEGIN RSA PRIVATE KEY-----", "[redacted:private-key-block]", 1),
        ("bearer " + "abcdefghij" * 3, "[redacted:bearer]", 1),
        ("password: abcdef", "password=[redacted]", 1),
        ("X_API_KEY=sk-" + KEY, "X_API_KEY=[redacted]", 2),
        ("postgres://me:hush123@host/db", "postgres://me:[redacted]@host/db", 1),
        ("密sk-" + KEY, "密sk-" + KEY, 0),
        ("", "", 0),
    ],
)
def test_masks(spark, given, masked, n):
    r = spark.createDataFrame([(given,)], "t string").select(redact(F.col("t")).alias("m")).first()["m"]
    assert (r["text"], r["redactions"]) == (masked, n)


def test_labels_and_lists(spark):
    r = spark.createDataFrame([("Tool-Calls ×5", "Projects touched: Alpha, b c (+2 more)", "/a/b/", "")], "a string, b string, c string, d string")
    got = r.select(text.label_key(F.col("a")), text.list_field(F.col("b")), text.base_name(F.col("c")), text.token_estimate(F.col("d")), text.token_estimate(F.col("a"))).first()
    assert tuple(got) == ("tool calls 5", ["Alpha", "b c"], "b", 1, 5)


def test_fences(spark):
    r = spark.createDataFrame([("```json\n{}\n```",), ("{}",)], "t string").select(text.unfence(F.col("t")).alias("u")).collect()
    assert [(x["u"]["text"], x["u"]["unfenced"]) for x in r] == [("{}", True), ("{}", False)]


def test_windows_of_time():
    now = dt.datetime(2026, 3, 1)
    assert timez.parse_since("48h", now) == dt.datetime(2026, 2, 27) and timez.parse_since("2w", now) == dt.datetime(2026, 2, 15)
    assert timez.parse_since("all", now) is None and timez.window_days("1y") == 365
    for bad in ("5m", "", "d7"):
        with pytest.raises(ValueError):
            timez.parse_since(bad, now)


def test_iso_instants(spark):
    df = spark.createDataFrame([("2026-02-01T10:00:00Z",), ("2026-02-01T12:00:00+02:00",), ("2026-02-01T10:00:00",), ("nope",), (None,)], "t string")
    assert [r[0] for r in df.select(F.unix_micros(timez.parse_iso(F.col("t")))).collect()] == [1769940000000000] * 3 + [None] * 2


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.normalised(F.col("a"))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[1][0] is None and got[2][0] is None
    assert got[1][1] == [1.0, 0.0]


def test_hash_embedding(spark):
    df = spark.createDataFrame([("one two",), ("two ONE",), ("",), (None,)], "t string").select(hashing.hash_embedding(F.col("t"), 16).alias("e"))
    a, b, c, d = [np.array(r["e"]) for r in df.collect()]
    assert np.allclose(a, b) and np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and c[0] == d[0] == 1


def test_preferences_that_pass(spark):
    rows = ["Fix the 500 in /retrieve", "You are testing the cache", "You added a link", "当前最重要的是部署", "Prefers uv over pip", "Keeps branches short", "You have a preference for tabs"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(validation.is_transient(F.col("t"))).collect()]
    assert got == [True, True, True, True, False, False, False]


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (("operational", "tool_preference", "x", 1.0, False), []),
        (("reflective", "identity_hypothesis", "x", 1.0, False), ["confirmation"]),
        (("reflective", "identity_hypothesis", "x", 1.0, True), []),
        (("operational", "identity_hypothesis", "x", 1.0, True), ["category"]),
        (("reflective", "tool_preference", "x", 1.0, True), ["category"]),
        (("operational", "other", "  ", 0.0, True), ["content", "decay_factor"]),
    ],
)
def test_memory_writes(spark, row, expected):
    df = spark.createDataFrame([row], "n string, c string, t string, d double, k boolean")
    v = validation.memory_violations(namespace=F.col("n"), category=F.col("c"), content=F.col("t"), decay_factor=F.col("d"), confirmed=F.col("k"))
    assert df.select(v).first()[0] == expected


def test_candidates_need_three_evidences_of_two_dates(spark):
    one, two = dt.date(2026, 2, 1), dt.date(2026, 2, 2)
    cases = {"too_little_evidence": [one], "dates": [one, one, one], None: [one, one, two]}
    for name, days in cases.items():
        df = spark.createDataFrame([("a description", [(d, "s", "i") for d in days], ["t2"], 0.5)], "d string, e array<struct<source_date: date, summary: string, source_id: string>>, c array<string>, f double")
        got = df.select(validation.candidate_violations(description=F.col("d"), evidence=F.col("e"), contexts=F.col("c"), confidence=F.col("f"))).first()[0]
        assert (name in got) if name else got == []


def test_an_edit_needs_wording(spark):
    df = spark.createDataFrame([("edit", None), ("edit", "long enough wording"), ("confirm", None), ("drop", None)], "d string, c string")
    got = [r[0] for r in df.select(validation.decision_violations(decision=F.col("d"), confirmed_content=F.col("c"))).collect()]
    assert got == [["wording"], [], [], ["decision"]]


DRAFT = '{"narrative": "You worked on the parser and then on its many tests.", "highlights": ["a"], "preferences": [], "open_threads": []%s}'


def test_drafts(spark):
    rows = [DRAFT % "", "```json\n" + DRAFT % "" + "\n```", DRAFT % ', "mood": "x"', DRAFT.replace("You worked", "You seemed glad") % "", "no json", "[]", '{"narrative": "short"}']
    got = extraction.validated(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")).orderBy("i").collect()
    assert [r["valid"] for r in got] == [True, True, False, False, False, False, False]
    assert got[1]["unfenced"] and got[2]["violations"] == ["extra_keys"] and got[3]["violations"] == ["feelings"] and got[4]["violations"] == ["json"]


def test_asking_until_valid(spark):
    prompts = spark.createDataFrame([(1, "s", "u")], "id long, system string, user string")
    got = extraction.ask(prompts, lambda: extraction.Scripted(["nope", "{}"]), extraction.is_object).collect()
    assert [(r["attempt_index"], r["raw"]) for r in got] == [(1, "nope"), (2, "{}")]
    assert extraction.ask(prompts, lambda: extraction.Scripted(["nope"]), extraction.is_object).count() == 3


def test_packing_keeps_the_budget(spark):
    rows = [(i, "s", "user" if i % 2 else "assistant", "x" * 5000, dt.datetime(2026, 2, 1, 0, i // 60, i % 60)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, session_id string, role string, content string, created_at timestamp")
    facts = spark.createDataFrame([("s", ["f"])], "session_id string, facts array<string>")
    packed = extraction.pack_prompts(df, facts, ["session_id"], system_tokens=100, max_input_tokens=4000)
    total = packed.agg(F.sum("cost")).first()[0]
    assert 0 < total <= 4000 and packed.count() < 400
    assert set(r["kind"] for r in packed.select("kind").distinct().collect()) == {"user", "assistant"}
    assert extraction.render(packed, facts, ["session_id"]).first()["sampled"] == packed.count()


def test_cache_decisions(spark):
    q = spark.createDataFrame([(1, "f", [1.0, 0.0]), (2, "g", [1.0, 0.0]), (3, "h", [0.0, 1.0]), (4, "i", [1.0, 0.0])], "query_id long, fingerprint string, embedding array<double>")
    e = spark.createDataFrame([(10, "f", [1.0, 0.0], "2026-12-01"), (11, "f", [0.999, 0.0], "2026-12-01"), (12, "g", [0.97, 0.0], "2026-12-01"), (13, "h", [0.5, 0.1], "2026-12-01"), (14, "i", [1.0, 0.0], "2020-01-01"), (15, "g", [0.2, 0.0], "2026-12-01")], "entry_id long, fingerprint string, embedding array<double>, x string").selectExpr("entry_id", "fingerprint", "embedding", "cast(x as timestamp) expires_at")
    got = {r["query_id"]: (r["outcome"], r["served_id"]) for r in cache.decide(q, e, "2026-06-01").collect()}
    assert got == {1: ("ambiguous", None), 2: ("served", 12), 3: ("below_threshold", None), 4: ("no_candidates", None)}


def test_sweep_and_separability(spark):
    rows = [("a", "a1", [1.0, 0.0], [1]), ("a", "a2", [0.99, 0.14], [1]), ("b", "b1", [0.0, 1.0], [2])]
    df = spark.createDataFrame(rows, "query_group string, query string, embedding array<double>, result_ids array<long>")
    got = {r["threshold"]: r for r in cache.sweep(df, (0.9, 0.999)).collect()}
    assert got[0.9]["requests"] == 6 and got[0.9]["semantic_hits"] == 2 and got[0.9]["false_hits"] == 0 and got[0.999]["semantic_hits"] == 0
    assert cache.separability(cache.query_pairs(df)).first()["separable"] is True
    assert cache.operating_point(cache.sweep(df, (0.9, 0.999))).first()["threshold"] == 0.9
    assert len(cache.THRESHOLDS) == 13


def test_measures(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(False, False)] * 4, "e boolean, a boolean")
    assert tuple(evaluation.confusion(df, F.col("e"), F.col("a")).first()) == (3, 0, 0, 4, 1.0, 1.0, 1.0)
    none = evaluation.confusion(df.where("not e"), F.col("e"), F.col("a")).first()
    assert none["precision"] is None and none["recall"] is None
    r = evaluation.compression(spark.createDataFrame([(287.0, 101.0, 139.7)], "raw_tokens double, card_tokens double, recall_tokens double")).first()
    assert r["reduction_percent"] == 16.1


def test_split_keeps_dates_together(spark):
    assert hashing.position("2026-02-01") == hashing.position("2026-02-01")
    from tidemark.schemas import PAIRS

    rows = [(f"2026-02-{1 + i % 9:02d}", f"s{i}" if i % 3 else None, [("user", f"p{i % 6}")], None, ("p", "m", 1, bool(i % 2), "2026-02-01T00:00:00")) for i in range(40)]
    pairs = spark.createDataFrame(rows, PAIRS)
    parts = dataset.split(dataset.last_pairs(pairs, F.col("meta.extracted_at")), 0.5)
    assert parts.groupBy("date").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    assert dataset.report(parts).count() <= 2
    assert dataset.chat_rows(pairs).first()["messages"][-1]["role"] == "assistant"


def test_middle_out(spark):
    long = "HEAD\nTRANSCRIPT:" + "a" * 300 + "MID" + "b" * 300
    df = spark.createDataFrame([(long,), ("short",)], "t string").select(dataset.middle_out(F.col("t"), 60))
    a, b = [r[0] for r in df.collect()]
    assert len(a) == 180 and a.startswith("HEAD\nTRANSCRIPT:a") and a.endswith("b") and "MID" not in a and b == "short"
    assert spark.createDataFrame([(long,)], "t string").select(dataset.middle_out(F.col("t"), 2)).first()[0] is None


def test_request_keys_and_memo():
    a, f = hashing.request_key(" Tabs ", {"k": 5, "w": "7d"})
    b, g = hashing.request_key("tabs", {"w": "7d", "k": 5})
    assert (a, f) == (b, g) != hashing.request_key("tabs", {"w": "7d", "k": 6})
    now = [0.0]
    memo = cache.ResultMemo(size=2, ttl=10, clock=lambda: now[0])
    assert memo.get("a", 1, lambda: "x") == "x" and memo.get("a", 1, lambda: "y") == "x"
    now[0] = 11
    assert memo.get("a", 1, lambda: "y") == "y"
    assert memo.get("a", 2, lambda: "z") == "z" and ("a", 1) not in memo.kept
    memo.get("b", 2, lambda: 1)
    memo.get("c", 2, lambda: 1)
    assert ("a", 2) not in memo.kept and (memo.hits, memo.misses) == (1, 5)


def test_widths_and_costs(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "e array<float>")
    assert len(df.select(validation.require_width(F.col("e"), 2)).collect()) == 2
    with pytest.raises(Exception, match="must have 3 numbers"):
        df.select(validation.require_width(F.col("e"), 3)).collect()
    got = spark.createDataFrame([("m", 2_000_000, 1_000_000, 7200.0)], "model string, input_tokens long, output_tokens long, wall double")
    assert evaluation.token_cost(got, {"m": (3.0, 15.0)}).first()["cost"] == 21.0
    assert got.select(evaluation.local_cost(F.col("wall"), 0.5)).first()[0] == 1.0
