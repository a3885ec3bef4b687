"""Queries without SQL, held against what they must give."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, vector_index
from tessera.plans import catalog, extended  # noqa: F401 registers

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


def test_index_query_finds_nine_of_ten_neighbours(spark):
    embeddings = catalog.table(spark, SF, "embeddings")
    exact = retrieval.top_k(embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding", embeddings, "vec_id", "embedding")
    found = catalog.QUERIES["r2_index_topk"](spark, SF)
    assert vector_index.recall_of(found, exact) >= 0.9 and found.select(F.countDistinct("query_id")).first()[0] == 5


def test_a_scan_a_plan_however_many_queries(spark):
    """Vectors are read once; what is broadcast was written before."""
    embeddings = catalog.table(spark, SF, "embeddings")
    plan = retrieval.top_k(embeddings, "vec_id", "embedding", embeddings, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("embeddings.parquet") == 1
