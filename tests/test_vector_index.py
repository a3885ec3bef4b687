import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, vector_index
from tessera.sources import store


def vectors(spark, n=3000, width=16, seed=2):
    dice = random.Random(seed)
    middles = [[dice.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = [(i, [m + dice.gauss(0, 0.5) for m in dice.choice(middles)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(400)]  # one vector many times
    rows += [(n + 500, None), (n + 501, [0.0] * width), (n + 502, [float("nan")] * width), (n + 503, [None] + [1.0] * (width - 1))]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(6)


def test_recall_and_the_share_that_is_compared(spark):
    df = vectors(spark)
    asked = df.where("id % 20 = 0")
    index = vector_index.build_index(df, "id", "v", store.scratch(spark))
    exact = retrieval.top_k(asked, "id", "v", df, "id", "v").cache()
    found = vector_index.search(spark, index, asked, "id", "v").cache()
    assert vector_index.recall_of(found, exact) >= 0.9
    assert index.probes < index.lists / 2
    assert found.groupBy("query_id").count().where("count <> 3").isEmpty()
    both = found.join(exact.withColumnRenamed("cosine_distance", "d"), ["query_id", "key"])
    assert both.where(F.abs(F.col("d") - F.col("cosine_distance")) > 1e-12).isEmpty()
    # every vector that can be found is in one list
    assert spark.read.parquet(index.path).select(F.explode("ids").alias("id")).groupBy("id").count().agg(F.count("*"), F.max("count")).first()[:] == (3400, 1)


def test_all_lists_give_the_exact_result(spark, monkeypatch):
    df = vectors(spark, 400, 8)
    asked = df.where("id % 10 = 0")
    index = vector_index.build_index(df, "id", "v", store.scratch(spark), lists=7)
    exact = sorted(map(tuple, retrieval.top_k(asked, "id", "v", df, "id", "v").collect()))
    for most in (64, -1):
        monkeypatch.setattr(vector_index, "BROADCAST_MB", most)
        assert [r[:3] for r in sorted(map(tuple, vector_index.search(spark, index, asked, "id", "v", probes=99).collect()))] == [r[:3] for r in exact]


def test_odd_inputs(spark):
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "id string, v array<float>")
    index = vector_index.build_index(few, "id", "v", store.scratch(spark))
    got = vector_index.search(spark, index, few, "id", "v", k=1, probes=index.lists).collect()
    assert {(r["query_id"], r["key"]) for r in got} == {("a", "a"), ("b", "b")}
    wide = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "id string, v array<float>")
    assert vector_index.search(spark, index, wide, "id", "v").count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build_index(few.where("false"), "id", "v", store.scratch(spark))
    with pytest.raises(ValueError, match="widths"):
        vector_index.build_index(few.unionAll(wide), "id", "v", store.scratch(spark))
