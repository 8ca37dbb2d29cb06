from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwork.operators.tree_agg import heavy_keys, tree_aggregate

SCHEMA = "k string, v long, d date, rows string"


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_equals_plain_group_by_with_hot_key(spark, rounds):
    day = dt.date(2026, 1, 1)
    data = [("hot" if i % 3 else f"k{i % 50}", i if i % 7 else None, day + dt.timedelta(i % 11) if i % 5 else None, "x") for i in range(3000)]
    df = spark.createDataFrame([*data, (None, 1, None, "x")], SCHEMA).repartition(9)
    states = {"rows": ("count", F.lit(1)), "n": ("count", F.col("v")), "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}
    got = tree_aggregate(df, {"k": F.col("k")}, states, ("days", F.col("d")), fan_in=2, rounds=rounds)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.countDistinct("d").alias("days"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_empty_table_and_heavy_keys(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tree_aggregate(empty, {"k": F.col("k")}, {"rows": ("count", F.lit(1))}).count() == 0
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] + [(None,)] * 3 + [("",)], "k string")
    per = tree_aggregate(df, {"k": F.col("k")}, {"rows": ("count", F.lit(1))})
    total = df.agg(F.count(F.lit(1)).alias("total"))
    assert [r.k for r in heavy_keys(per, "k", "rows", total, 0.3).collect()] == ["a"]
    assert {r.k for r in heavy_keys(per, "k", "rows", total, 0.1).collect()} == {"a", "b"}
