"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: A-Z lowered, words of non-blank bytes, shingles joined by one space (fewer words: the whole sequence),
XXH64 with seed 42; a bit is set if it is set in over half the shingle hashes. No words: fingerprint zero.

Covering: each bit position gets a random vector of radius + 1 bits; for each of the 2^(radius+1) - 1 nonzero
vectors v the mask keeps the bits whose vector has odd inner product with v. For any set of radius positions some v
is orthogonal to all of their vectors, so any two fingerprints within the radius agree on some whole masked value:
every such pair meets in a bucket of some table. A bucket's fingerprints are compared exactly, and a spanning forest
of its links is emitted, not all pairs; buckets over BUCKET fingerprints are cut into blocks, and each pair of blocks
is compared in a task of its own.

Defined results: equal fingerprints are collapsed first (copies cost nothing); null and empty text have fingerprint
zero and link to each other; rows with equal ids keep their own fingerprints; a null id gets a component as any other
and never names one, unless all ids of the component are null; an empty table gives an empty one.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, has_columns, materialize, release_memory, widened, worker_cache
from tessera.llm.graph import components

BUCKET = 20_000
SEGMENT = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LANES = np.uint64(0x0101010101010101)
_WHITE = bytes(range(9, 14)) + b" "
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = bytes.maketrans(bytes(range(9, 14)), b" " * 5)


def _runs(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words in runs of about SEGMENT bytes, which overlap by size - 1 words; a last one of fewer than size is new to none."""
    words: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.end() if found else len(text)
        words += [w for w in text[at:end].translate(_LOWER).translate(_BLANK).split(b" ") if w]
        at = end
        if len(words) >= size or at >= len(text):
            yield words
            words = words[len(words) - size + 1 :] if size > 1 else []


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included. Long texts are read in segments, so that memory is that of the hashes."""
    digest, parts = xxhash.xxh64_intdigest, []
    for words in _runs(text, size):
        n = len(words) - size + 1
        if n < 1:
            if words and not parts:
                return np.array([digest(b" ".join(words), 42)], np.uint64)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        parts.append(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the 64 bits that are set in over half of them.

    Eight bits of different bytes are counted at a time in the byte lanes of one word, over runs of at most 255.
    """
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([hashes[i] for i in some])
    sizes = sizes[some]
    runs = -(-sizes // 255)
    first_run = np.concatenate(([0], np.cumsum(runs)[:-1]))
    inside = np.arange(runs.sum()) - np.repeat(first_run, runs)
    starts = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), runs) + 255 * inside
    bits = np.zeros(len(some), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            bits |= (counts[:, byte] * 2 > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    out[some] = bits
    return out


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 4) -> DataFrame:
    """docs' other columns plus name: the fingerprint as a signed long (an existing column of that name is replaced). Texts are
    read as UTF-8, in slices of bounded size."""
    has_columns(docs, text)
    keep = [c for c in docs.columns if c != text and c.lower() != name.lower()]
    source = widened(docs.select(*keep, F.col(text).cast("binary").alias(fresh(docs, "_text"))))
    schema = source.select(*keep, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            column = batch.column(len(keep))
            prints = np.zeros(batch.num_rows, np.uint64)
            held: list[np.ndarray] = []
            size = at = 0
            for i in range(batch.num_rows):
                h = shingle_hashes(column[i].as_py() or b"", shingle)
                held.append(h)
                size += len(h)
                if size > 300_000:
                    prints[at : i + 1] = majority(held)
                    held, size, at = [], 0, i + 1
            if held:
                prints[at:] = majority(held)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(prints.view(np.int64))], names=[*keep, name])
        release_memory()

    return source.mapInArrow(run, schema)


def masks(radius: int, seed: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 covering masks over 64 bits, as signed longs. Bit vectors cycle through all nonzero values
    in a seeded order, so that each mask keeps about half of the bits."""
    top = 1 << (radius + 1)
    vectors: list[int] = []
    dice = random.Random(seed)
    while len(vectors) < 64:
        round_ = list(range(1, top))
        dice.shuffle(round_)
        vectors += round_
    out = []
    for v in range(1, top):
        m = sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values at radius or fewer differing bits."""
    edges: list[tuple[int, int]] = []
    left = values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return edges


def _links(radius: int, keys: int, named: bool):
    """mapInArrow body: rows arrive sorted by their first columns (the bucket); the last column is the fingerprint. named: the
    first of the bucket's columns comes out with each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        held_key, held = None, np.empty(0, np.uint64)
        out: list[tuple[int, int]] = []
        names: list[int] = []

        def flush() -> None:
            if len(held) == 2:
                if int(held[0] ^ held[1]).bit_count() <= radius:
                    out.append((int(held[0]), int(held[1])))
            elif len(held) > 2:
                out.extend(forest(held, radius))
            if named and held_key:
                names.extend([held_key[0]] * (len(out) - len(names)))

        def made() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            ends = [pa.array(np.ascontiguousarray(pairs[:, side])) for side in (0, 1)]
            return pa.RecordBatch.from_arrays([*([pa.array(names, pa.int16())] if named else []), *ends], names=[*(["by"] if named else []), "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
            fps = batch.column(keys).to_numpy().view(np.uint64)
            change = np.zeros(len(fps), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(fps)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                key = tuple(c[s] for c in cols)
                if key == held_key:
                    held = np.concatenate((held, fps[s:e]))
                else:
                    flush()
                    held_key, held = key, fps[s:e]
            if len(out) > 50_000:
                yield made()
                out.clear()
                names.clear()
        flush()
        yield made()

    return run


def links(prints: DataFrame, name: str, radius: int, bucket: int = BUCKET, reach: int | None = None, by: str | None = None) -> DataFrame:
    """(a, b): links that connect exactly what the relation "radius or fewer differing bits" connects. With a greater reach, also
    those up to reach bits that happen to share a bucket. by: a short column within whose values alone fingerprints are linked,
    which comes first in the result, as by."""
    table = F.array(*[F.lit(m) for m in masks(radius)])
    near, own = reach or radius, ["by"] if by else []
    schema = "by short, a long, b long" if by else "a long, b long"
    spark = prints.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = (
        prints.select(*([F.col(by).alias("by")] if by else []), F.col(name).alias("fp"))
        .repartition(spread, "fp").distinct()  # a small table would be one task, and each row becomes one for each mask
        .select(*own, "fp", F.posexplode(table).alias("t", "mask"))
        .select(*own, F.col("t").cast("short").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    )
    key = [*own, "t", "k"]
    sizes = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = keyed.join(sizes.hint("merge"), key)  # the planner takes keyed for as small as what it was exploded from, and would broadcast it
    small = met.where(F.col("n") <= bucket).select(*key, "fp").repartition(*key).sortWithinPartitions(*key)
    out = small.mapInArrow(_links(near, len(key), bool(by)), schema)
    # beyond the bucket size: every pair of blocks is a group of its own, so none is larger than two blocks
    blocks = met.where(F.col("n") > bucket).withColumn("m", F.ceil(F.col("n") / F.lit(bucket / 2)).cast("int")).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    pairs = blocks.select(*key, "x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("y"), "fp").select(*key, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "fp")
    large = pairs.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j").mapInArrow(_links(near, len(key) + 2, bool(by)), schema)
    return out.unionAll(large)


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the least id that links reach."""
    has_columns(docs, doc_id, text)
    rows = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, "fp", radius), "a", "b")
    linked = roots.select(F.col("node").alias("fp"), "root").unionAll(roots.select(F.col("root").alias("fp"), "root").distinct())
    names = linked.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("name"), F.lit(True).alias("linked"))
    named = linked.join(names, "root").select("fp", "name", "linked")
    named = materialize(nodes.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id")))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
