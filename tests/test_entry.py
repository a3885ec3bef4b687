import os

import pytest


def test_registry():
    import __spark_entry__ as e

    found, sql = e.queries(), e.oracle_sql()
    assert len(found) > 60 and set(sql) <= set(found) and all(callable(f) for f in found.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are missing")
def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(r["context"].startswith("[Fonte ") for r in rows)


def test_the_library_does_not_import_the_training_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tessera")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "tessera.llm" not in f.read()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are missing")
def test_flagship_has_whole_texts(spark):
    import __spark_entry__ as e

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = e.entry(spark).collect()
    found = [(r["context"], int(line.split("]")[0].split("[")[1])) for r in rows for line in r["sources"].split("\n")]
    assert max(len(texts[d]) for _, d in found) > 80 and all(texts[d] in c for c, d in found)
