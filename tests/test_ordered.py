import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered


def test_positions_of_a_large_group_ties_and_nulls(spark):
    dice = random.Random(1)
    rows = [(dice.choice(["a", "a", "a", "b", None]), dice.choice([None, *range(40)]), i) for i in range(2000)] + [("c", 1, 5000)] + [("d", 3, 6000)] * 50
    df = spark.createDataFrame(rows, "g string, k int, _at long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.positions(df, ["k", "_at"], ["g"], name="i", count="n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none_first = lambda v: (v is not None, v)
    for g in {r[0] for r in rows}:
        own = sorted([r for r in got if r["g"] == g], key=lambda r: r["i"])
        assert [(r["k"], r["_at"]) for r in own] == sorted([(k, at) for x, k, at in rows if x == g], key=lambda r: (none_first(r[0]), r[1]))
        assert [r["i"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}


def test_no_window_over_more_than_a_row_a_partition(spark):
    df = spark.range(100_000).withColumn("g", F.lit(7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.positions(df, ["id"], ["g"], name="i")
        assert got.where("i <> id").count() == 0 and got.count() == 100_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = got._jdf.queryExecution().toString()
    assert "Window" in plan and plan.count("rangepartitioning") == 0  # dealt once, before the table was written


def test_positional_join(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1), ("z", 2)], "name string, k int")
    b = spark.createDataFrame([(10, "third"), (8, "first"), (9, "second")], "at int, name string")
    got = ordered.positional_join(a, b, ["k"], ["at"]).orderBy("position").collect()
    assert [(r["position"], r["name"], r["name_right"]) for r in got] == [(0, "y", "first"), (1, "z", "second"), (2, "x", "third")]


def test_unequal_lengths_are_an_error(spark):
    a, b = spark.range(5).toDF("k"), spark.range(6).toDF("at")
    for left, right in ((a, b.withColumnRenamed("at", "k2")), (b.withColumnRenamed("at", "k2"), a)):
        with pytest.raises(Exception, match="differ in length"):
            ordered.positional_join(left, right, [left.columns[0]], [right.columns[0]]).collect()


def test_empty(spark):
    none = spark.createDataFrame([], "k int, g string")
    assert ordered.positions(none, ["k"], ["g"]).count() == 0
    assert ordered.positional_join(none, none.toDF("k2", "g2"), ["k"], ["k2"]).count() == 0
