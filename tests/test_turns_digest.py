from pyspark.sql import functions as F

from tests.conftest import at
from tidemark.functions import timez
from tidemark.operators import cards, digest, patterns, turns
from tidemark.schemas import CARDS, TURNS

NY = "America/New_York"


def turn(i, session="s", role="user", ts="2026-02-01T12:00:00", key=None, project=None, branch=None, tools=(), tokens=1):
    return (i, session, role, f"t{i}", "log", tokens, at(ts) if ts else None, key, project, branch, list(tools))


def table(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def test_window_keeps_the_latest_oldest_first(spark):
    df = table(spark, [turn(i, ts=f"2026-02-01T12:{i:02d}:00") for i in range(15)])
    kept = turns.session_window(df, 12).orderBy("position").collect()
    assert [r["id"] for r in kept] == list(range(3, 15))
    assert sorted(r["id"] for r in turns.evicted(df, 12).collect()) == [0, 1, 2]
    s = turns.buffer_stats(df, 12).first()
    assert (s["turns"], s["tokens"], s["evicted"]) == (12, 12, 3)


def test_upsert_first_of_a_batch_and_backfill(spark):
    stored = table(spark, [turn(1, key="a"), turn(2, key="b", project="old", tools=["x"])])
    batch = table(spark, [turn(0, key="a", project="p", tools=["t"]), turn(0, key="b", project="new", tools=["y"]), turn(0, key="c", ts="2026-02-01T10:00:00", project="first"), turn(0, key="c", ts="2026-02-01T11:00:00", project="second")]).drop("id")
    after, new = turns.upsert(stored, batch)
    assert new.count() == 1
    got = {r["source_key"]: r for r in after.collect()}
    assert got["a"]["project"] == "p" and got["a"]["tool_names"] == ["t"]
    assert got["b"]["project"] == "new" and got["b"]["tool_names"] == ["x"]
    assert got["c"]["project"] == "first" and got["c"]["id"] > 2
    again, none = turns.upsert(after, batch)
    assert none.count() == 0 and again.count() == 3


def test_ties_of_tools_go_by_first_appearance(spark):
    df = table(spark, [turn(1, tools=["zeta", "alpha"], ts="2026-02-01T12:00:00"), turn(2, tools=["alpha", "zeta"], ts="2026-02-01T12:01:00")])
    got = digest.tool_counts(df.withColumn("period", F.lit("d")), ["period"]).first()["tools"]
    assert [t["name"] for t in got] == ["zeta", "alpha"]


def test_late_activity_is_the_small_hours_turn(spark):
    df = table(spark, [turn(1, ts="2026-02-01T09:43:00"), turn(2, ts="2026-02-02T01:00:00")])
    facts = digest.day_cards(df, NY).first()["facts"]
    assert any("at 04:43 local" in f for f in facts)
    assert any(f.startswith("Active 04:43–20:00 local (15h17m span)") for f in facts)


def test_projects_beyond_three_are_counted(spark):
    df = table(spark, [turn(i, project=p, ts=f"2026-02-01T12:0{i}:00") for i, p in enumerate("abcd")])
    facts = digest.day_cards(df, "UTC").first()["facts"]
    assert facts[0] == "Projects touched: a, b, c (+1 more)"


def test_session_cards_need_enough_turns(spark):
    df = table(spark, [turn(i, "log:aaaaaaaaaa", ts=f"2026-02-01T12:0{i}:00") for i in range(6)] + [turn(10 + i, "log:short", ts=f"2026-02-01T12:0{i}:00") for i in range(5)])
    got = digest.session_cards(df, "UTC").collect()
    assert [r["session_id"] for r in got] == ["log:aaaaaaaaaa"]
    assert got[0]["summary"] == "session aaaaaaaa — 6 turns in unknown project from 12:00."


def test_empty_days_are_rebuilt_too(spark):
    df = table(spark, [turn(1)])
    got = {r["period"]: r["summary"] for r in digest.rebuild(df, spark.createDataFrame([("2026-02-01",), ("2026-02-05",)], "period string"), "UTC").collect()}
    assert got["2026-02-05"] == "No agent activity recorded." and got["2026-02-01"].startswith("1 turns")


def test_days_of_23_and_25_hours(spark):
    days = spark.createDataFrame([("2026-03-08",), ("2026-11-01",), ("2026-06-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    b = days.select("d", timez.day_bounds(F.col("d"), NY).alias("b")).select("d", ((F.unix_micros("b.end") - F.unix_micros("b.start")) / 3.6e9).alias("h"))
    assert {str(r["d"]): r["h"] for r in b.collect()} == {"2026-03-08": 23.0, "2026-11-01": 25.0, "2026-06-01": 24.0}


def test_span_is_wall_clock(spark):
    df = spark.createDataFrame([(at("2026-03-08T06:00:00"), at("2026-03-08T08:00:00"))], "a timestamp, b timestamp")
    assert df.select(timez.span_minutes(F.col("a"), F.col("b"), NY)).first()[0] == 180


def card(i, period, facts, session=None, narrative=None):
    t = at("2026-02-01T00:00:00")
    return (i, session, period, "s", facts, 1, t, t, narrative, [], "rule", None, None)


def test_cards_scopes_and_null_safe_keys(spark):
    df = spark.createDataFrame([card(1, "2026-02-01", ["f"]), card(2, "2026-02-01", ["f"], "x"), card(3, "2026-02-02", ["f"], narrative="told")], CARDS)
    assert [r["id"] for r in cards.listed(df).collect()] == [3, 1]
    assert [r["id"] for r in cards.listed(df, scope="session").collect()] == [2]
    assert [r["id"] for r in cards.listed(df, scope="all").collect()] == [3, 1, 2]
    assert [r["id"] for r in cards.get(df, "2026-02-01").collect()] == [1]
    assert [r["id"] for r in cards.missing_narrative(df).collect()] == [1, 2]


def test_narrative_is_laid_over_and_survives_a_digest(spark):
    df = spark.createDataFrame([card(1, "2026-02-01", ["f"])], CARDS)
    u = spark.createDataFrame([("2026-02-01", None, "told", [], ["open"], "model", "m", None)], "period string, session_id string, narrative string, highlights array<string>, open_threads array<string>, generated_by string, model string, extracted_at timestamp")
    told = cards.narrate(df, u)
    r = told.first()
    assert r["narrative"] == "told" and r["developer_behavior_facts"] == ["f"] and r["summary"] == "s"
    w = spark.createDataFrame([("2026-02-01", None, "again", ["g"], at("2026-02-03T00:00:00")), ("2026-02-09", "s1", "new", ["h"], at("2026-02-03T00:00:00"))], "period string, session_id string, summary string, developer_behavior_facts array<string>, updated_at timestamp")
    after = {r["period"]: r for r in cards.upsert(told, w).collect()}
    assert after["2026-02-01"]["narrative"] == "told" and after["2026-02-01"]["developer_behavior_facts"] == ["g"]
    assert after["2026-02-09"]["generated_by"] == "rule" and len(after) == 2


def test_three_days_of_a_project_make_a_candidate(spark):
    df = spark.createDataFrame([card(i, f"2026-02-0{i}", ["Projects touched: Alpha"]) for i in (1, 2, 3)], CARDS)
    got = patterns.mine(df).collect()
    assert len(got) == 1
    assert got[0]["description"] == "Repeated project work tied to alpha." and len(got[0]["supporting_evidence"]) == 3
    assert got[0]["confidence"] == 0.65 and got[0]["contexts"] == ["t2", "project"]


def test_one_date_makes_none_and_odd_periods_are_ignored(spark):
    one = spark.createDataFrame([card(i, "2026-02-01", ["Projects touched: Alpha"]) for i in (1, 2, 3)], CARDS)
    assert patterns.mine(one).count() == 0
    odd = spark.createDataFrame([card(i, p, ["Projects touched: Alpha"]) for i, p in enumerate(("2026-08", "2026-8-20", "2026-02-30"))], CARDS)
    assert patterns.observations(odd).count() == 0


def test_known_candidates_are_left_out(spark):
    df = spark.createDataFrame([card(i, f"2026-02-0{i}", ["Tool calls: Read-File ×5"]) for i in (1, 2, 3)], CARDS)
    known = spark.createDataFrame([("Frequent TOOL preference around read file",)], "description string")
    assert patterns.mine(df).first()["description"] == "Frequent tool preference around read file."
    assert patterns.mine(df, known).count() == 0
