import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tests.llm.conftest import DOCS, rows

COLUMNS = merkle.COLUMNS


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, arity):
    """(root, [(before, after) from the leaf up] of each leaf) of one tree, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // arity * arity
            paths[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + arity])))
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [k // arity for k in at]
    return level[0], paths


def plain_manifest(docs, arity):
    """{(id, leaf): (subroot, root, path)} by the definition."""
    trees = {}
    for r in docs:
        trees.setdefault(r["lang"], []).append((r["doc_id"], sha(*[plain_field(r[c]) for c in COLUMNS])))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: (sorted(trees[k], key=lambda x: (x[0] is not None, x)), None) for k in order}
    built = {k: (own, plain_tree([x[1] for x in own], arity)) for k, (own, _) in built.items()}
    root, upper = plain_tree([built[k][1][0] for k in order], arity)
    return sorted(((i, k, at, leaf, built[k][1][0], root, built[k][1][1][at] + upper[j]) for j, k in enumerate(order) for at, (i, leaf) in enumerate(built[k][0])), key=repr)


def told(found):
    return sorted(((r["id"], r["group"], r["position"], r["leaf"], r["subroot"], r["root"], [(p["before"], p["after"]) for p in r["path"]]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_equals_the_definition(spark, docs, arity):
    found = merkle.manifest(docs, arity=arity)
    assert told(found) == plain_manifest(docs.collect(), arity)
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()


def test_a_large_group_over_many_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, "en").when(F.col("id") % 2 > 0, "é").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert told(merkle.manifest(df)) == plain_manifest(df.collect(), 8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_build_from_leaves_in_any_order(spark, n):
    leaves = [sha(str(i)) for i in range(n)]
    rows_ = [("t", n, i, x) for i, x in enumerate(leaves)]
    random.Random(4).shuffle(rows_)
    links, roots, height = merkle.build(spark.createDataFrame(rows_, "tree string, n long, idx long, digest string").repartition(7))
    assert roots.first()["digest"] == plain_tree(leaves, 8)[0] and roots.count() == 1
    assert roots.first()["level"] == height
    assert links.count() == sum(merkle._width(n, k, 8) for k in range(1, height + 1))


def test_parents_wait_for_as_many_children_as_they_have():
    leaves = [("t", 10, 0, i, sha(str(i))) for i in range(10)]
    first, second = list(merkle.combine(iter(leaves[:9]), 8)), list(merkle.combine(iter(leaves[8:]), 8))
    assert [(x[0], x[3], x[4]) for x in first] == [("link", 1, 0), ("open", 1, 0), ("open", 0, 8)]
    assert [(x[0], x[3], x[4]) for x in second] == [("link", 1, 1), ("open", 1, 1)]  # a last run of two
    assert {x[0] for x in merkle.combine(iter(leaves), 8)} == {"link", "root"}


def test_tampered_rows_fail_and_others_do_not(spark, docs):
    checked = merkle.leaf_digest(*[F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")) if c == "text" else F.col(c) for c in COLUMNS])
    found = merkle.manifest(docs, checked=checked).withColumn("ok", merkle.fold(F.col("checked_leaf"), F.col("path")) == F.col("root"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found.collect():
        changed = r["id"] is not None and r["id"] % 5 == 0 and texts[r["id"]] is not None
        assert r["ok"] is not changed


def test_lone_row_lone_group_and_empty_table(spark):
    one = merkle.manifest(spark.createDataFrame(rows()[:1], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
    none = merkle.manifest(spark.createDataFrame([], DOCS))
    assert none.count() == 0 and none.columns == ["id", "group", "position", "leaf", "checked_leaf", "subroot", "root", "path"]
    with pytest.raises(ValueError):
        merkle.manifest(none)


def test_clashing_columns(spark, docs):
    taken = docs.select("*", *[F.lit(1).alias(c) for c in ("tree", "idx", "n", "digest", "checked", "level", "PATH", "root", "id")])
    assert told(merkle.manifest(taken)) == told(merkle.manifest(docs))
