import pytest
from pyspark.sql import functions as F

from tessera.operators import dialogue, ordered, reports, shapes

SHAPE = {"$": "object", "$.id": "string", "$.planner": "object", "$.planner.success": "boolean", "$.planner.calls": "array?", "$.planner.calls[]": "object", "$.planner.calls[].server": "string", "$.score": "number|null"}


def problems(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    return sorted(tuple(r)[1:] for r in shapes.shape_problems(df, "i", "body", SHAPE).collect())


@pytest.mark.parametrize(
    ("body", "found"),
    [
        ('{"id": "a", "planner": {"success": true, "calls": [{"server": "w"}, {"server": "p"}]}, "score": 1}', []),
        ('{"id": "a", "planner": {"success": false}, "score": null}', []),
        ('{"id": "a", "planner": {"success": false}, "score": 0.5}', []),
        ("nonsense", [("$", "not JSON")]),
        (None, [("$", "not JSON")]),
        ("[1]", [("$", "array, not object")]),
        ('{"id": 3, "planner": {"success": "yes"}}', [("$.id", "int, not string"), ("$.planner.success", "string, not boolean"), ("$.score", "missing")]),
        ('{"id": "a", "planner": {"success": true, "calls": [{"server": 1, "x": 2}, 3, {}]}, "score": "s"}', [("$.planner.calls[]", "int, not object"), ("$.planner.calls[].server", "int, not string"), ("$.planner.calls[].server", "missing"), ("$.planner.calls[].x", "added"), ("$.score", "string, not number|null")]),
        ('{"id": "a", "planner": [], "score": 1, "a.b": {"c": 1}}', [("$.a.b", "added"), ("$.planner", "array, not object")]),
    ],
)
def test_problems_by_path(spark, body, found):
    assert problems(spark, body) == found


def test_records_of_an_empty_table(spark):
    assert shapes.shape_problems(spark.createDataFrame([], "i int, body string"), "i", "body", SHAPE).count() == 0


def test_first_n_keeps_n_a_task_before_the_exchange(spark):
    df = spark.range(20_000).select((F.col("id") % 3 * 0).alias("g"), (F.lit(20_000) - F.col("id")).alias("k")).repartition(8)
    got = ordered.first_n(df, ["g"], ["k"], 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")
    assert [(r["k"], r["rank"]) for r in got.orderBy("rank").collect()] == [(i, i) for i in range(1, 6)]
    with pytest.raises(ValueError):
        ordered.first_n(df, ["g"], ["k"], 2000)


def test_unique_names(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2), (None, 9)], "name string, i int")
    got = sorted((r["name"] or "", r["i"], r["unique_name"]) for r in ordered.unique_names(df, "name", ["i"]).collect())
    assert got == [("", 9, None), ("a", 1, "a"), ("a", 2, "a#2"), ("a", 3, "a#3"), ("b", 2, "b")]


def test_report_of_tables_with_odd_cells(spark):
    t = spark.createDataFrame([("b|c", None), ("a\nb", 2.5)], "k string, v double")
    text = reports.render(spark, "T", [reports.Section("One", t, ["k", "v"], ["k"]), reports.Section("Two", text="No table.")]).first()["report"]
    assert text == "# T\n\n## 1. One\n\n| k | v |\n|---|---|\n| a b | 2.5 |\n| b\\|c | - |\n\n## 2. Two\n\nNo table.\n"
    assert reports.render(spark, "T", [reports.Section("None", t.where("false"), ["k"])]).first()["report"] == "# T\n\n## 1. None\n\n| k |\n|---|"


def test_dispatch_loses_no_row(spark):
    rows = spark.createDataFrame([(1, "rules"), (2, "rag"), (3, None), (4, "other")], "id int, route string")
    out = dialogue.dispatch(rows, "route", {"rules": lambda d: d.select("id", F.lit("R").alias("reply")), "rag": lambda d: d.select("id", F.lit("G").alias("reply"))})
    assert {(r["id"], r["reply"], r["error"]) for r in out.collect()} == {(1, "R", None), (2, "G", None), (3, None, "no route"), (4, None, "no branch for other")}
    told = spark.range(1).select(dialogue.routing_lines(F.create_map(F.lit("eliza"), F.lit(0.054), F.lit("rag"), F.lit(0.946)), F.lit("rag")))
    assert told.first()[0] == "[router]\neliza=0.05\nrag=0.95\nselected=rag"
