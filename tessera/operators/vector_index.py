"""Approximate top-k: an inverted file over unit vectors, searched without comparing all.

Centers are found by spherical k-means on a bounded sample; every vector is then filed under its nearest center, as blocks in
a table partitioned by that list. A query meets only the blocks of the `probes` lists whose centers are nearest to it, by an
equi-join on the list. How many lists are probed is measured when the index is built: for a bounded sample of vectors as
queries, their exact neighbours are found, and the least number of probes that reaches the target recall is kept.
With as many probes as lists the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import BLOCK, BROADCAST_MB, block, nearest_of_blocks, packed, size_mb, top_k
from tessera.sources.store import stored

MOST_LISTS = 4096
SAMPLE_NUMBERS = 8_000_000
TUNING_QUERIES = 256
RECALL = 0.95


@dataclass(frozen=True)
class Index:
    path: str
    centers: np.ndarray
    probes: int

    @property
    def lists(self) -> int:
        return len(self.centers)


def _centers(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit vectors, nearest by dot product; a center without vectors stays."""
    dice = np.random.default_rng(seed)
    centers = sample[dice.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[lo : lo + 8192] @ centers.T).argmax(axis=1) for lo in range(0, len(sample), 8192)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        centers = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-30)[:, None], centers)
    return centers


def _filed(blocks: DataFrame, centers: np.ndarray, lists: int) -> DataFrame:
    """(list, key, v): each vector of packed blocks beside its `lists` nearest centers."""
    schema = blocks.select(F.lit(0).alias("list"), F.get("ids", F.lit(0)).alias("key"), F.lit(b"").alias("v")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in zip(batch.column(0), batch.column(1), strict=True):
                ids, m = ids.values, np.frombuffer(m.as_buffer(), "<f8").reshape(len(ids.values), -1)
                near = np.argpartition(-(m @ centers.T), lists - 1, axis=1)[:, :lists]
                at = np.repeat(np.arange(len(m)), lists)
                rows = np.array([v.astype("<f8").tobytes() for v in m], object)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), ids.take(pa.array(at)), pa.array(rows[at], pa.binary())], names=schema.names)

    return blocks.select("ids", "m").mapInArrow(run, schema)


def _by_list(filed: DataFrame) -> DataFrame:
    """(list, ids, m): blocks of one list each; rows are dealt by (list, hash of the key), so that a large list is in many tasks."""
    schema = filed.select("list", F.array("key").alias("ids"), F.lit(b"").alias("m")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
            for a, b in zip(edges, edges[1:], strict=False):
                for lo in range(a, b, BLOCK):
                    part = batch.slice(lo, min(BLOCK, b - lo))
                    yield block(schema.names, [int(lists[lo])], part.column(1), np.stack([np.frombuffer(x.as_buffer(), "<f8") for x in part.column(2)]))

    return filed.repartitionByRange("list", F.xxhash64("key")).sortWithinPartitions("list").mapInArrow(run, schema)


def build_index(vectors: DataFrame, key: str, vector: str, path: str, k: int = 3, lists: int | None = None, recall: float = RECALL, tuning_queries: int = TUNING_QUERIES) -> Index:
    """Write the lists of all vectors under path. Vectors that can't be found by top_k (null, zero, not finite) are in no list; vectors
    of several widths are an error."""
    blocks = stored(packed(vectors, key, vector))
    n, widths, width = blocks.agg(F.sum(F.size("ids")), F.countDistinct("width"), F.max("width")).first()
    if not n:
        raise ValueError("no vectors to index")
    if widths > 1:
        raise ValueError("vectors of several widths")
    lists = min(lists or max(1, round(n**0.5)), MOST_LISTS, n)
    usable = F.col(vector).isNotNull() & (F.size(vector) == width)
    first = vectors.where(usable).select(F.col(key).alias("key"), F.col(vector).alias("v")).orderBy(F.xxhash64("key", F.lit(11)), "key").limit(max(lists, SAMPLE_NUMBERS // width))
    sample = [np.frombuffer(r["m"], "<f8").reshape(-1, width) for r in packed(first, "key", "v").toLocalIterator()]  # SAMPLE_NUMBERS numbers
    sample = np.concatenate(sample)
    centers = _centers(sample, min(lists, len(sample)))
    _by_list(_filed(blocks, centers, 1)).write.mode("overwrite").partitionBy("list").parquet(path)
    asked = vectors.where(usable).select(F.col(key).alias("key"), F.col(vector).alias("v")).orderBy(F.xxhash64("key", F.lit(12)), "key").limit(tuning_queries)
    return Index(path, centers, _probes(stored(asked), vectors, key, vector, path, centers, k, recall))


def _probes(asked: DataFrame, vectors: DataFrame, key: str, vector: str, path: str, centers: np.ndarray, k: int, recall: float) -> int:
    """The least number of probes with that recall: the place of each exact neighbour's list among the lists of its query."""
    exact = top_k(asked, "key", "v", vectors, key, vector, k)
    where = vectors.sparkSession.read.parquet(path).select(F.explode("ids").alias("key"), "list")
    found = where.join(F.broadcast(stored(exact)), "key").select("query_id", "list").toPandas()  # tuning_queries x k rows at most
    blocks = packed(asked, "key", "v").toPandas()
    ids = np.concatenate([np.asarray(x) for x in blocks["ids"]])
    rank = np.argsort(np.argsort(-(np.concatenate([np.frombuffer(x, "<f8").reshape(len(i), -1) for x, i in zip(blocks["m"], blocks["ids"], strict=True)]) @ centers.T), axis=1), axis=1)
    at = {q: i for i, q in enumerate(ids.tolist())}
    places = np.sort([rank[at[q], c] for q, c in zip(found["query_id"].tolist(), found["list"], strict=True)])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def search(spark: SparkSession, index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int = 3, probes: int | None = None) -> DataFrame:
    """(query_id, rank, key, cosine_distance) as top_k gives it, over the lists that are probed."""
    probes = min(probes or index.probes, index.lists)
    usable = packed(queries, query_id, query_vector).where(F.col("width") == index.centers.shape[1])
    asked = stored(_by_list(_filed(usable, index.centers, probes)).toDF("list", "queries", "qm"))
    lists = spark.read.parquet(index.path)
    small = size_mb(asked.select(F.col("qm").alias("m"))) <= BROADCAST_MB
    return nearest_of_blocks(lists.join(F.broadcast(asked) if small else asked, "list"), k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's rows (query_id, key) that found has."""
    own = exact.select("query_id", "key")
    n = own.count()
    return own.join(found.select("query_id", "key"), ["query_id", "key"], "left_semi").count() / n if n else 1.0
