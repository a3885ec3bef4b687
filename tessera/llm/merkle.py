"""Merkle manifest of a dataset: a tree of digests over the rows of each group, a tree over the groups, and proofs.

The leaf of a row hashes its columns, each with its length. Leaves have gapless positions within their group, in the
order of the ids (operators/ordered.py deals them by range, so that a group may hold any share of the rows). ARITY
consecutive nodes become their parent, until one is left, the group's subroot; the subroots, in the order of the groups,
become the root in the same way.

Parents are built by events, as combineByKey does it, not level by level: a task keeps partial parents by (group, level,
position), each with the digests of the children that have come, by their place; the number of children that a parent
waits for follows from the group's size. When the last one comes, the parent's digest is emitted and is itself a child
that has come. Leaves arrive by range, so that nearly all parents are finished where their leaves were read. Children whose
parent stayed partial, at the borders of tasks, are the frontier: it is dealt out anew by the ancestor STEP levels higher,
so that a task gets whole subtrees of at most ARITY ** STEP nodes each, and combined in the same way, until only roots are
left. After t rounds the frontier lies above level t * STEP; the number of rounds follows from the largest group.

Every finished parent is written with its children in order: the link from it to them, reversed, is the proof of each
child. Proofs are spread from the roots down, a join per level over ever larger tables, of which the last, over the
parents of leaves, has a row for ARITY leaves; leaves join that one once, and fold their proof in place.

Defined results: columns of any type are hashed by their string form, nulls as a dash; null groups come first and are a
group; rows of one id in a group are ordered by their leaf; a lone leaf is its group's subroot, and a lone group's subroot is
the root; an empty table gives an empty manifest; existing columns of the names that are added are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import has_columns, materialize
from tessera.operators.ordered import positions

ARITY = 8
STEP = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, n long, level int, idx long, digest string"


def field(value: Column) -> Column:
    """A dash for null, else the length in bytes, a colon, and the value's string form."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _height(n: int, arity: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


@lru_cache(1 << 16)
def _width(n: int, level: int, arity: int) -> int:
    """Nodes of a level over n leaves."""
    for _ in range(level):
        n = -(-n // arity)
    return n


def combine(nodes: Iterator[tuple], arity: int) -> Iterator[tuple]:
    """Nodes (tree, n, level, idx, digest) in any order in; out: ("link", *parent, digests of its children) of each parent that
    is finished, ("root", *node, None) of each tree's last node, and ("open", *node, None) of children that still wait."""
    partial: dict[tuple, dict[int, str]] = {}
    for tree, n, level, idx, digest in nodes:
        while True:
            width = _width(n, level, arity)
            if width == 1:
                yield "root", tree, n, level, idx, digest, None
                break
            up, slot = divmod(idx, arity)
            key = (tree, n, level + 1, up)
            came = partial.setdefault(key, {})
            came[slot] = digest
            if len(came) < min(arity, width - up * arity):
                break
            children = [came[i] for i in range(len(came))]
            del partial[key]
            level, idx, digest = level + 1, up, hashlib.sha256("".join(children).encode()).hexdigest()
            yield "link", tree, n, level, idx, digest, children
    for (tree, n, level, up), came in partial.items():
        for slot, digest in came.items():
            yield "open", tree, n, level - 1, up * arity + slot, digest, None


def _combined(nodes: DataFrame, arity: int) -> DataFrame:
    schema = f"kind string, {_NODE}, children array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())]
        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

        for row in combine(rows, arity):
            made.append(row)
            if len(made) == 4096:
                yield batch()
                made.clear()
        if made:
            yield batch()

    return nodes.mapInArrow(run, schema)


def build(leaves: DataFrame, arity: int = ARITY, step: int = STEP) -> tuple[DataFrame, DataFrame, int]:
    """(links, roots, greatest height) over leaves (tree, n, idx, digest): links (tree, level, idx, digest, children) of all
    parents, roots (tree, n, level, digest) with a row for each tree."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    height = _height(most, arity)
    frontier = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    made = []
    for turn in range(1, height // step + 3):
        made.append(materialize(_combined(frontier, arity)))
        frontier = made[-1].where("kind = 'open'").drop("kind", "children")
        if frontier.isEmpty():
            break
        # nodes that share the ancestor at this level, which is one above their own at least, meet in a task
        shift = F.greatest(F.lit(turn * step) - F.col("level"), F.lit(1))
        up = F.floor(F.col("idx") / F.pow(F.lit(arity), shift)).cast("long") if arity & (arity - 1) else F.expr(f"shiftright(idx, {arity.bit_length() - 1} * greatest({turn * step} - level, 1))")
        frontier = frontier.withColumn("up", up).withColumn("at", F.col("level") + shift).repartition("tree", "at", "up").drop("up", "at")
    else:
        raise RuntimeError("the frontier did not end: positions within a tree must be gapless and n its leaves")
    every = made[0]
    for m in made[1:]:
        every = every.unionAll(m)
    return every.where("kind = 'link'").drop("kind", "n"), every.where("kind = 'root'").select("tree", "n", "level", "digest"), height


def _side(children: Column, lo: Column, n: Column) -> Column:
    return F.array_join(F.slice(children, lo, n), "")


def _siblings(children: Column, slot: Column) -> Column:
    """The digests before and after slot, joined."""
    return F.struct(_side(children, F.lit(1), slot).alias("before"), _side(children, slot + 2, F.size(children) - 1 - slot).alias("after"))


def paths(links: DataFrame, roots: DataFrame, height: int, arity: int = ARITY) -> DataFrame:
    """(tree, idx, children, path) of the parents of leaves: path is what lies beside each node from the parent itself up to
    the tree's root, then roots' own path. roots: (tree, level, path)."""
    down = None
    for level in range(height, 0, -1):
        at = roots.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("idx"), "path")
        at = at if down is None else at.unionAll(down)
        here = links.where(F.col("level") == level).join(at, ["tree", "idx"]).select("tree", "idx", "children", "path")
        if level == 1:
            return here
        slot = F.col("slot")
        spread = here.select("tree", "idx", "children", "path", F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("slot"))
        down = spread.select("tree", (F.col("idx") * arity + slot).alias("idx"), F.concat(F.array(_siblings(F.col("children"), slot)), "path").alias("path"))
    return links.select("tree", "idx", "children").join(roots.select("tree", "path"), "tree").where("false")


_NO_PATH = "array<struct<before: string, after: string>>"


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def tree_paths(leaves: DataFrame, upper: DataFrame | None = None, arity: int = ARITY, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(leaves (tree, idx, digest, *keep, subroot, path), roots) over leaves (tree, n, idx, digest, *keep). With upper (tree,
    path), the path goes on from the tree's root."""
    links, roots, height = build(leaves.select("tree", "n", "idx", "digest"), arity)
    return _with_paths(leaves, links, roots, height, upper, arity, keep), roots


def _with_paths(leaves: DataFrame, links: DataFrame, roots: DataFrame, height: int, upper: DataFrame | None, arity: int, keep: tuple[str, ...]) -> DataFrame:
    none = F.array().cast(_NO_PATH)
    tops = roots.select("tree", "level", "digest")
    tops = tops.join(upper.select("tree", "path"), "tree") if upper is not None else tops.withColumn("path", none)
    tops = materialize(tops)  # a row a tree
    lone = tops.where("level = 0").select("tree", F.lit(0).cast("long").alias("up"), F.lit(None).cast("array<string>").alias("children"), "path")
    near = paths(links, tops.select("tree", "level", "path"), height, arity).select("tree", F.col("idx").alias("up"), "children", "path").unionAll(lone)
    both = leaves.select("tree", "idx", "digest", *keep, F.floor(F.col("idx") / arity).cast("long").alias("up")).join(near, ["tree", "up"])
    slot = (F.col("idx") % arity).cast("int")
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(F.array(_siblings(F.col("children"), slot)), "path"))
    return both.select("tree", "idx", "digest", *keep, path.alias("path"))


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, arity: int = ARITY, checked: Column | None = None) -> DataFrame:
    """(id, group, position, leaf, checked_leaf, subroot, root, path) of every row. checked is the leaf to verify in the row's place,
    such as one computed from another copy of the row; without it, the row's own. fold(checked_leaf, path) equals root if
    the row is unchanged; path[0] has the siblings of the leaf, the last entry those below the root."""
    has_columns(docs, doc_id, group, *columns)
    own = leaf_digest(*[F.col(c) for c in columns])
    label = F.concat(F.lit("="), F.col(group).cast("string"))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(label, F.lit("")).alias("tree"), own.alias("digest"), (own if checked is None else checked).alias("checked"))
    # texts are read once, before ranges are sampled, and only digests move
    leaves = materialize(positions(materialize(rows), ["id", "digest"], ["tree"], "idx", "n"))
    links, roots, height = build(leaves.select("tree", "n", "idx", "digest"), arity)
    roots = materialize(roots)
    # the trees' order is that of their labels, null ("") first; a table of one row a tree
    tops = positions(roots.select(F.col("tree").alias("sub"), "digest"), ["sub"], name="idx", count="n").withColumn("tree", F.lit("root"))
    upper, top = tree_paths(materialize(tops), arity=arity, keep=("sub",))
    found = _with_paths(leaves, links, roots, height, upper.select(F.col("sub").alias("tree"), "path"), arity, ("id", "checked"))
    root = top.first()  # one row
    facts = roots.select("tree", F.col("digest").alias("subroot"), F.lit(root["digest"] if root else None).cast("string").alias("root"))
    named = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("group")
    return found.join(facts, "tree").select("id", named, F.col("idx").alias("position"), F.col("digest").alias("leaf"), F.col("checked").alias("checked_leaf"), "subroot", "root", "path")
