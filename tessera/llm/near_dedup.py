"""SimHash near-dedup of texts: covering locality-sensitive hashing finds candidates, exact shingle sets confirm each link.

Two texts are linked if the sets of their five-word shingles (those of simhash) have a Jaccard similarity of the
threshold or more. Texts of equal sets are one node, so that copies cost nothing.

Candidates: a node has PRINTS SimHash fingerprints of 64 bits, each over its two-word shingles under another rehash of
them: an edit changes fewer short shingles than long ones, so that similar texts differ in fewer bits. For each
fingerprint the covering masks of simhash guarantee that nodes within RADIUS bits meet in a bucket, and nodes of a bucket
within REACH bits are candidates. The components of these candidates are groups, outside of which no candidates are.
Links are then exact: the sets of a group meet in one task, where a spanning forest of the links of the threshold or more
is found, whether or not two of its nodes were candidates. Groups of over GROUP shingles are cut into blocks, and each
pair of blocks is compared in a task of its own. Fingerprints are taken AT_ONCE at a time, and the shuffles of some go
before the next.

Recall is a matter of probability, as the fingerprints of similar texts may all differ in more bits: the README has the
measured share by similarity. No unlike texts are linked.

Defined results: texts without words (null ones too) have the empty set, and link to each other only; rows of an id with
unlike texts are different texts, each of which is kept or goes on its own; a null id is an id as any other and is kept
only where its component has no other; repeated rows leave one; an empty table gives an empty one; other columns pass
through, whatever their names. A component holds chains of links: each of its texts is similar to another one of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import appended, fresh, has_columns, materialize, release_memory, widened, worker_cache
from tessera.llm.graph import components
from tessera.llm.simhash import links as covered
from tessera.llm.simhash import majority, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
PRINTS, PRINT_WORDS = 24, 2
RADIUS, REACH = 4, 8
AT_ONCE = 5
GROUP = 2_000_000
_HASHES = 300_000
_TURNS = np.random.default_rng(64).integers(0, 1 << 64, (PRINTS, 2), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def node_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def prints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """texts x PRINTS fingerprints from the texts' shingle hashes."""

    def again(h: np.ndarray, turn: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * turn[0]
        h = (h ^ (h >> np.uint64(29))) * turn[1]
        return h ^ (h >> np.uint64(32))

    sizes = np.cumsum([0, *map(len, hashes)])
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    cuts = list(zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True))
    rehashed = (again(flat, turn) for turn in _TURNS)
    return np.stack([majority([x[s:e] for s, e in cuts]) for x in rehashed], axis=1)


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, node, n, prints) of docs (doc_id, text): n is the size of the set."""
    source = widened(docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text")))
    schema = source.select("doc_id", "text_key", F.lit(b"").alias("node"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("prints")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_dedup")

        def made(part: pa.RecordBatch, names: list[bytes], sizes: list[int], short: list[np.ndarray]) -> pa.RecordBatch:
            prints = prints_of(short).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(prints) + 1, PRINTS, dtype=np.int32)), pa.array(prints))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), lists], names=schema.names)

        for batch in batches:
            names, sizes, short, held, at = [], [], [], 0, 0
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py() or b""
                full = shingle_set(text, shingle)
                names.append(node_name(full))
                sizes.append(len(full))
                short.append(shingle_hashes(text, PRINT_WORDS))
                held += len(short[-1])
                if held > _HASHES or i + 1 == batch.num_rows:
                    yield made(batch.slice(at, i + 1 - at), names, sizes, short)
                    names, sizes, short, held, at = [], [], [], 0, i + 1
        release_memory()

    return source.mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, set, n) of texts (text): set holds sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_dedup")
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                sets = [shingle_set(x.as_py() or b"", shingle) for x in batch.column(0).slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([node_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["node", "set", "n"])
        release_memory()

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node binary, set binary, n long")


def forest(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Edges that connect what the relation "Jaccard similarity of threshold or more" connects among different sets."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        shared = sizes.sum() - len(np.unique(np.concatenate(sets)))
        return [(0, 1)] if shared * (1 + threshold) >= threshold * sizes.sum() - 1e-9 and shared else []
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(codes, kind="stable")]
    starts, at = np.cumsum(often) - often, np.cumsum(sizes) - sizes

    def near(x: int) -> np.ndarray:
        own = codes[at[x] : at[x] + sizes[x]]
        n = often[own]
        places = np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
        shared = np.bincount(holders[places], minlength=len(sets))
        return (shared * (1 + threshold) >= threshold * (sizes + sizes[x]) - 1e-9) & (shared > 0)

    edges: list[tuple[int, int]] = []
    left, queue = np.ones(len(sets), bool), []
    while left.any():
        if not queue:
            queue = [int(np.argmax(left))]
            left[queue[0]] = False
        elif left.sum() <= len(queue):  # fewer to ask from the other side: all links that are still missing are theirs
            edges += [(int(x), int(y)) for x in np.flatnonzero(left) for y in np.flatnonzero(near(x)) if x != y]
            break
        x = queue.pop()
        found = np.flatnonzero(near(x) & left)
        edges += [(x, int(y)) for y in found]
        queue += found.tolist()
        left[found] = False
    return edges


def _confirmed(threshold: float):
    """mapInArrow body: rows (root, i, j, node, set) arrive sorted by group; gives the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_dedup")
        held_key, held = None, {}

        def made() -> pa.RecordBatch:
            names, pairs = list(held), forest([np.frombuffer(x, np.uint64) for x in held.values()], threshold) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[p[side]] for p in pairs], pa.binary()) for side in (0, 1)], names=["a", "b"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for root, i, j, node, hashes in zip(*(batch.column(c).slice(lo, 500).to_pylist() for c in range(5)), strict=True):
                    if (root, i, j) != held_key:
                        yield made()
                        held_key, held = (root, i, j), {}
                    held[node] = hashes
        yield made()
        release_memory()

    return run


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): edges that connect what the fingerprints link. nodes: (node, prints).

    The first fingerprint's links are brought to components before the others' are taken: of those only what joins different
    components is kept, so that a large group of near copies has about one edge a node, not one for each mask.
    """

    def of_prints(lo: int, hi: int) -> DataFrame:
        own = nodes.select("node", F.posexplode("prints").alias("at", "fp")).where((F.col("at") >= lo) & (F.col("at") < hi)).select("node", F.col("at").cast("short").alias("by"), "fp")
        first = own.groupBy("by", "fp").agg(F.min("node").alias("first"))
        equal = own.join(first, ["by", "fp"]).where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
        pairs = covered(own, "fp", RADIUS, reach=REACH, by="by")
        for side in ("a", "b"):
            pairs = pairs.join(first.select("by", F.col("fp").alias(side), F.col("first").alias(f"{side}_node")), ["by", side])
        return equal.unionAll(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))

    found = materialize(components(of_prints(0, 1), "a", "b"))

    def joining(lo: int) -> DataFrame:
        pairs = of_prints(lo, lo + AT_ONCE)
        for side in ("a", "b"):
            pairs = pairs.join(found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
        ends = pairs.select(*[F.coalesce(f"{side}_root", side).alias(side) for side in ("a", "b")])
        return ends.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    return appended(joining(lo) for lo in range(1, PRINTS, AT_ONCE)).unionAll(found.select(F.col("root").alias("a"), F.col("node").alias("b"))).distinct()


def links(rows: DataFrame, docs: DataFrame, shingle: int, threshold: float, group: int = GROUP) -> DataFrame:
    """(a, b): confirmed links between nodes. rows: (doc_id, text_key, node, n, prints); docs: (doc_id, text)."""
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    nodes = materialize(rows.where("n > 0").groupBy("node").agg(one, F.any_value("prints").alias("prints")))
    near = components(candidates(nodes), "a", "b")
    groups = materialize(near.select("node", "root").unionAll(near.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "one.*"), "node"))
    read = groups.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    texts = docs.join(read, docs["doc_id"].eqNullSafe(F.col("_id")) & (_text_key(docs["text"]) == F.col("_key")), "left_semi")
    sets = materialize(shingle_sets(texts, shingle).join(groups.select("node", "root"), "node"))
    cuts = sets.groupBy("root").agg(F.sum("n").alias("all")).select("root", F.when(F.col("all") > group, F.ceil(F.col("all") / F.lit(group / 2))).otherwise(1).cast("int").alias("m"))
    dealt = sets.join(cuts, "root").withColumn("x", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    pairs = dealt.select("root", "x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("y"), "node", "set").select("root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "node", "set")
    return pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_confirmed(threshold), "a binary, b binary")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, node, component, component_id) for each row: component is the name of a node, component_id the
    least id that confirmed links reach."""
    has_columns(docs, doc_id, text)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(sketches(plain, shingle).select("doc_id", "text_key", "node", "n", "prints"))
    roots = materialize(components(links(rows, plain, shingle, threshold, group), "a", "b"))
    placed = rows.drop("n", "prints").join(roots, "node", "left").select("doc_id", "text_key", "node", F.coalesce("root", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(names, "component").select("doc_id", "text_key", "node", "component", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row for each component: the least id's (null last), of its texts the first by digest, of its repeated rows
    the first by all columns that can be ordered."""
    found = materialize(near_components(docs, doc_id, text, shingle, threshold).select("doc_id", "text_key", "component"))
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one"), F.count(F.lit(1)).alias("n"))
    often = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    key, digest, rows, turn = (fresh(docs, n) for n in ("_kept_id", "_digest", "_rows", "_turn"))
    kept = kept.select(F.col("one.doc_id").alias(key), F.col("one.text_key").alias(digest))
    kept = kept.join(often.select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_t"), F.col("rows").alias(rows)), F.col(key).eqNullSafe(F.col("_i")) & (F.col(digest) == F.col("_t"))).select(key, digest, rows)
    own = docs.join(kept, F.col(doc_id).eqNullSafe(F.col(key)) & (_text_key(F.col(text)) == F.col(digest)))
    once = own.where(F.col(rows) == 1).select(*docs.columns)
    # only rows that are repeated move a second time
    order = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    again = own.where(F.col(rows) > 1).withColumn(turn, F.row_number().over(Window.partitionBy(key, digest).orderBy(*order)))
    return once.unionAll(again.where(F.col(turn) == 1).select(*docs.columns))
