"""Every registered query beside its SQL, on the smallest driver tables."""

import decimal
import glob
import os

import duckdb
import pytest

from tessera.plans import catalog, extended, structure  # noqa: F401 all register

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are missing")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    result = db.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, rows) == table(columns, result.fetchall())


def test_scans_read_only_what_they_need(spark):
    plan = catalog.QUERIES["j4_j6_missing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lang" in plan and "html" not in plan and "n_chars" not in plan
