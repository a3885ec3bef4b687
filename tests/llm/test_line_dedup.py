import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup


@pytest.mark.parametrize(("salts", "broadcast"), [(line_dedup.SALTS, "10MB"), (line_dedup.SALTS, "-1"), (3, "-1"), (1, "-1")])
def test_against_brute(spark, docs, salts, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        brute(docs, salts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_salts_split_a_large_host(spark):
    pages = spark.createDataFrame([(i, "big" if i < 900 else f"s{i % 4}", "same\nown") for i in range(1000)], "id long, source string, text string")
    found = line_dedup.boilerplate(pages, "source", "text")
    assert {r["_site"]: r["_pages"] for r in found.collect()} == {"=big": 900, **{f"=s{k}": 25 for k in range(4)}}
    dealt, lists = line_dedup.salted(pages, found, "source", "text", "site", "salt", 10)
    sizes = {(r["site"], r["salt"]): r["count"] for r in dealt.groupBy("site", "salt").count().collect()}
    assert sum(k[0] == "=big" for k in sizes) == 9 and max(sizes.values()) < 200
    keys = [tuple(r) for r in lists.select("site", "salt").collect()]
    assert len(keys) == len(set(keys)) and set(sizes) <= set(keys) and len(keys) <= 5 + 2 * 10
    # all lines are on all pages
    assert line_dedup.line_dedup(pages, salts=10).where(F.col("text") != "").count() == 0


def brute(docs, salts):
    rows = docs.collect()
    pages, counts = Counter(), Counter()
    for r in rows:
        pages[r["source"]] += 1
        counts.update((r["source"], x) for x in set((r["text"] or "").split("\n")) if r["text"] is not None and re.search(r"[^\x20\x09-\x0D]", x))
    bad = {k for k, n in counts.items() if n >= 2 and n > 0.05 * pages[k[0]]}
    assert bad
    want = sorted((str(r["doc_id"]), None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in bad) or "") for r in rows if r["text"] is not None)
    out = line_dedup.line_dedup(docs, ratio=0.05, min_pages=2, salts=salts)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"] is not None) == want
    assert sum(r["text"] is None for r in got) == 2


def test_counts_and_empty(docs, empty):
    r = line_dedup.line_dedup(docs, ratio=0.05, min_pages=2, counts=True).agg({"n_lines": "sum", "n_dropped": "sum"}).first()
    assert r["sum(n_lines)"] > r["sum(n_dropped)"] > 0
    assert line_dedup.line_dedup(empty, counts=True).count() == 0
