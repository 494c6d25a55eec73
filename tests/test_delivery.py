import pytest

from tests.conftest import at
from tidemark.operators import delivery

SCHEMA = "id long, key string, arrived timestamp, _first string, extra int"
T = [at("2026-01-01T00:00:00"), at("2026-01-02T00:00:00")]


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("hot", [1_000_000, 2])
def test_first_arrival_wins_and_ties_go_to_the_lowest_id(spark, hot):
    df = rows(spark, [(5, "a", T[0], None, 1), (2, "a", T[0], None, 2), (1, "a", T[1], "x", 3), (9, "b", None, None, 4), (7, "b", T[1], None, 5), (3, None, T[0], None, 6), (4, None, T[0], None, 7), (8, "c", T[0], "y", 8)])
    df = df.withColumnRenamed("_first", "note")
    surplus = {r[0] for r in delivery.surplus_rows(df, "key", "arrived", "id", hot_rows=hot).collect()}
    assert surplus == {5, 1, 9}
    kept = delivery.first_deliveries(df, "key", "arrived", "id", hot_rows=hot)
    assert kept.columns == df.columns
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4, 7, 8]


def test_repeated_rows_leave_one(spark):
    df = rows(spark, [(1, "a", T[0], None, 1)] * 3)
    assert delivery.first_deliveries(df, "key", "arrived", "id").count() == 1
    assert delivery.surplus_rows(df, "key", "arrived", "id").count() == 0


def test_empty_table(spark):
    df = rows(spark, [])
    assert delivery.surplus_rows(df, "key", "arrived", "id").count() == 0
    assert delivery.first_deliveries(df, "key", "arrived", "id").count() == 0


def test_new_batch_against_the_store(spark):
    stored = spark.createDataFrame([("a",), (None,)], "key string")
    batch = rows(spark, [(1, "a", T[0], None, 1), (2, "b", T[0], None, 1), (3, "b", T[0], None, 1), (4, None, T[0], None, 1)])
    got = delivery.new_deliveries(batch, stored, "key", "arrived", "id")
    assert sorted(r["id"] for r in got.collect()) == [2, 4]
    assert got.columns == batch.columns
