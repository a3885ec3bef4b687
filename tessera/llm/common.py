"""What the operators of this folder share: words, let-binding, materialised intermediates, global positions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import scratch, shuffles_dropped, widened  # noqa: F401 widened is used through this module
from tessera.sources.store import stored as materialize  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 20_000
SLICE_BYTES = 8_000_000

_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator; what it kept for others goes, as workers are reused."""
    for other in [k for k in _caches if k != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {})


def release_memory() -> None:
    """Give what the allocators of this worker hold unused back to the system; an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` bytes of the column each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    bins = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def appended(parts: Iterable[DataFrame]) -> DataFrame:
    """All parts in one written table, as materialize does. Each part's shuffles go before the next one runs, so that disk
    holds those of one part at a time."""
    path, schema = None, None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or scratch(spark), df.schema
        with shuffles_dropped(spark):
            df.write.mode("append").parquet(path)
    if path is None:
        raise ValueError("no parts")
    return spark.read.schema(schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the files of a table that materialize or appended gave, before the application ends."""
    spark = written.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in written.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getName().startswith("tessera-"):
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def has_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (names compare without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number(df: DataFrame, key: list[str], order: list[Column], spread: Column, name: str) -> DataFrame:
    """Add gapless 0-based positions within key as column name, without gathering a key in one task.

    Rows of a key are dealt into buckets by spread (leading order: bucket, then order); each bucket is numbered by a
    window and shifted by the counts of the key's earlier buckets, a table of keys x buckets rows.
    """
    b, n, base = fresh(df, "_bucket"), fresh(df, "_n"), fresh(df, "_base")
    dealt = df.withColumn(b, spread.cast("int"))
    counts = dealt.groupBy(*key, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) if key else Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    at = Window.partitionBy(*key, b).orderBy(*order)
    return dealt.withColumn(name, F.row_number().over(at) - 1).join(bases, [*key, b]).withColumn(name, (F.col(name) + F.col(base)).cast("long")).drop(b, base)


def bucket_count(rows: int, per: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // per))
