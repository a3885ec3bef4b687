"""Centroid clustering of integer vectors, with block-norm screening in front of exact distances.

A vector is cut into segments; the norms of its segments, computed once, are its compressed form. By Cauchy-Schwarz,
segment by segment, |x - c|^2 >= sum over segments of (|x_s| - |c_s|)^2, which compressed vectors give alone. A vector
takes its centroids by rising bound and computes exact integer distances until the next bound lies above the best one:
all that are left can't win, nor tie. Bounds are lowered by SLACK of the squared norms, more than what rounding can add,
so that results are those of all exact distances.

A round sends the centroids (k x dims numbers) to the tasks; each task sums its vectors by centroid and component in
64-bit integers, so that k x (dims + 1) sums a task are shuffled and as many reach the driver, however many vectors
there are, and however many of them share a centroid. Floors of means are taken in exact integers.

Defined results: only vectors with exactly `dims` components, none null, NaN or infinite, are kept; a component x becomes
floor(scale * x), held to +-2^27 so that distances fit 64 bits; with fewer vectors than k there are as many centroids as
vectors; equal vectors, and rows that are repeated, are vectors of their own; ties go to the smaller number, and seeds of
equal hash (repeated ids) come by their components; a null id is hashed as the word null; sums of distances beyond 64
bits are null; an empty table gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import has_columns, materialize, worker_cache

K = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEGMENTS = 16
SLACK = 1e-9
LIMIT = 1 << 27
_ROWS = 4096


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """Norms of the segments (of equal width, but for the last ones) of rows of integers: rows x segments."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    return np.sqrt(np.add.reduceat(np.square(x.astype(np.int64)), edges, axis=1).astype(np.float64))


@dataclass(frozen=True)
class Centroids:
    points: np.ndarray  # k x dims, integers
    norms: np.ndarray  # k x segments

    @classmethod
    def of(cls, points: np.ndarray, segments: int) -> Centroids:
        return cls(points, segment_norms(points, segments))

    def bounds(self, norms: np.ndarray) -> np.ndarray:
        """A number below each squared distance, from compressed vectors: vectors x k."""
        squares = np.square(norms).sum(axis=1)[:, None] + np.square(self.norms).sum(axis=1)[None, :]
        return squares * (1 - SLACK) - 2 * norms @ self.norms.T

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance, exact distances that were computed) of each vector."""
        bound = self.bounds(norms)
        order = np.argsort(bound, axis=1, kind="stable")
        best = np.full(len(x), np.iinfo(np.int64).max)
        cluster, tested = np.full(len(x), len(self.points)), np.zeros(len(x), np.int64)
        left = np.arange(len(x))
        for rank in range(len(self.points)):
            c = order[left, rank]
            open_ = bound[left, c] <= best[left]
            left, c = left[open_], c[open_]
            if not len(left):
                break
            d = np.square(x[left] - self.points[c]).sum(axis=1)
            tested[left] += 1
            wins = (d < best[left]) | ((d == best[left]) & (c < cluster[left]))
            best[left[wins]], cluster[left[wins]] = d[wins], c[wins]
        return cluster, best, tested


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, x, norms) of the vectors that are kept: integer components and the norms of their segments."""
    has_columns(vectors, vec_id, embedding)
    e = F.col(embedding)
    finite = F.forall(e, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))  # NaN is the largest double
    kept = vectors.where(F.coalesce((F.size(e) == dims) & finite, F.lit(False)))
    whole = F.transform(e, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    rows = kept.select(F.col(vec_id).alias("vec_id"), whole.alias("x"))
    schema = rows.select("vec_id", "x", F.array(F.lit(0.0)).alias("norms")).schema

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            norms = segment_norms(x, segments) if len(x) else np.zeros((0, segments))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * segments), pa.array(norms.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "x", "norms"])

    return rows.mapInArrow(compress, schema)


def _parts(batches: Iterator[pa.RecordBatch], dims: int, segments: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches (vec_id, x, norms) of bounded size: rows, vectors, norms."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            yield part, part.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int64), part.column(2).flatten().to_numpy().reshape(-1, segments)


def _sums(near: Centroids, dims: int, segments: int):
    """mapInArrow body: for each centroid the sum of each component over the task's vectors, and as component `dims` their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("clustering")
        k = len(near.points)
        total = np.zeros((k, dims + 1), np.int64)
        for _, x, norms in _parts(batches, dims, segments):
            cluster, _, _ = near.nearest(x, norms)
            order = np.argsort(cluster, kind="stable")
            own, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
            total[own, :dims] += np.add.reduceat(x[order], first, axis=0)
            total[own, dims] += n
        at = np.flatnonzero(total[:, dims])
        cols = [np.repeat(at, dims + 1).astype(np.int32), np.tile(np.arange(dims + 1, dtype=np.int32), len(at)), total[at].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cluster", "component", "total"])

    return run


def _assigned(near: Centroids, dims: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("clustering")
        for part, x, norms in _parts(batches, dims, segments):
            cluster, best, tested = near.nearest(x, norms)
            cols = [part.column(0), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(tested.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance", "n_exact"])

    return run


def seeds(kept: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors of least SHA-256 of salt and id, in that order."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = kept.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS, salt: str = "2:"
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, n_exact) of every kept vector, the final centroids). n_exact counts the centroids that
    the vector's bounds left for an exact distance in the last assignment."""
    if not 1 <= segments <= dims:
        raise ValueError("segments must be 1 to dims")
    kept = materialize(integer_vectors(vectors, vec_id, embedding, dims, scale, segments))
    points = seeds(kept, k, salt)
    schema = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("n_exact")).schema
    if not len(points):
        return kept.sparkSession.createDataFrame([], schema), points.reshape(0, dims)
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(Centroids.of(points, segments), dims, segments), "cluster int, component int, total long")
        found = sums.groupBy("cluster", "component").agg(F.sum("total").alias("total")).toArrow()  # k x (dims + 1) rows at most
        total = np.zeros((len(points), dims + 1), np.int64)
        total[found.column("cluster").to_numpy(), found.column("component").to_numpy()] = found.column("total").to_numpy()
        full = np.flatnonzero(total[:, dims])
        points = points.copy()
        points[full] = np.floor_divide(total[full, :dims], total[full, dims:])  # rounds towards minus infinity, in integers
    return kept.mapInArrow(_assigned(Centroids.of(points, segments), dims, segments), schema), points


def cluster_report(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """cluster_vectors' rows with cluster_inertia and inertia (sums of distances) and centroid_sha256, of the decimal components
    joined by commas."""
    found, points = cluster_vectors(vectors, vec_id, embedding, k, rounds, dims, scale, segments)
    found = materialize(found)
    spark = vectors.sparkSession
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # k rows at most
    by, digests = {r["cluster"]: int(r["s"]) for r in sums}, [hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest() for p in points]
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(n), fits(sum(by.values())), digests[c]) for c, n in by.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")
