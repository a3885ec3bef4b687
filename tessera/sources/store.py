"""Where operators keep intermediates: Parquet in the folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share, or the folder of setCheckpointDir. A temporary folder only where both
    are unset and the executors are threads of this process; elsewhere an error, as they would not see one another's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    placed = context._jsc.sc().getCheckpointDir()
    if placed.isDefined():
        return placed.get().rstrip("/")
    master = context.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch(spark: SparkSession) -> str:
    """A new path in the work folder, which goes when the application ends."""
    path = f"{work_dir(spark)}/tessera-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in this block go with its query, not when the driver next collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read back: its lineage is cut, it survives lost executors, and the planner knows its size."""
    return Pieces().add(df)


class Pieces:
    """A table that grows by pieces, each written once, and is read as one scan of all of them."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """The piece, as it was written."""
        spark, path = df.sparkSession, scratch(df.sparkSession)
        with shuffles_dropped(spark):
            df.write.parquet(path)
        self.paths.append(path)
        self.read, self.schema = spark.read, df.schema
        return spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.read.schema(self.schema).parquet(*self.paths)

    def discard(self) -> None:
        """Delete the pieces before the application ends; nothing that reads them may be left."""
        deleted(*self.paths)
        self.paths = []


def deleted(*paths: str) -> None:
    """Delete folders of the work folder."""
    context = SparkSession.active().sparkContext
    for name in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def widened(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores. Only a bare scan with fewer is dealt out, which is a table of a few
    file splits; anything larger, or already exchanged, is returned as it is."""
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Adaptive" in plan.executedPlan().getClass().getSimpleName() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
