"""Calls of services at scale: typed failures, traces, schedules by host, and runs that can be stopped and resumed.

Services are injected callables. Calls run in the tasks, a bounded number at a time; whatever a call does becomes a row, so
that a failing service never fails a job.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.ordered import positions
from tessera.sources.store import stored

WORKERS = 4
TIMEOUT = 15.0
RESULT = "struct<body: string, failure: string, message: string>"


@dataclass(frozen=True)
class Response:
    """What a transport gives: the status and the body of an answer."""

    status: int
    body: str


def outcome(transport: Callable[[str], Response | str], request: str) -> tuple[str | None, str | None, str | None]:
    """(body, failure, message) of one call. Failures: timeout, connection, status, empty, not_json, and error for the rest. A body
    is JSON, and not blank."""
    try:
        said = transport(request)
    except TimeoutError as e:
        return None, "timeout", str(e) or "timed out"
    except ConnectionError as e:
        return None, "connection", str(e) or type(e).__name__
    except Exception as e:  # noqa: BLE001 any failure of a service is a result
        return None, "error", str(e) or type(e).__name__
    if isinstance(said, Response):
        if said.status >= 400:
            return None, "status", f"status {said.status}"
        said = said.body
    if not said or not said.strip():
        return None, "empty", "no body"
    try:
        json.loads(said)
    except ValueError:
        return None, "not_json", said[:80]
    return said, None, None


def call_service(df: DataFrame, request: str, transport: Callable[[str], Response | str], result: str = "result", workers: int = WORKERS, timeout: float = TIMEOUT) -> DataFrame:
    """Df with column `result` (RESULT), of at most `workers` calls at a time in a task, in the order of the rows. A call that takes
    more than `timeout` seconds from when it is waited for is a timeout, and its thread is left behind. Null requests aren't
    sent and give null."""
    keep = [c for c in df.columns if c.lower() != result.lower()]
    source = df.select(F.col(request).cast("string").alias("request_"), F.struct(F.lit(0).alias("_"), *keep).alias("row_"))
    schema = source.select("row_", F.lit(None).cast(RESULT).alias("result_")).schema
    kind = to_arrow_type(schema["result_"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(workers)
        try:
            for batch in batches:
                asked = batch.column(0).to_pylist()
                made: list = []
                todo = iter(asked)
                while chunk := list(islice(todo, workers)):  # no more than these wait at a time
                    calls = [None if r is None else pool.submit(outcome, transport, r) for r in chunk]
                    for c in calls:
                        try:
                            made.append(None if c is None else c.result(timeout))
                        except Late:
                            made.append((None, "timeout", f"no answer in {timeout:g} s"))
                            pool = ThreadPoolExecutor(workers)  # the stuck thread keeps its place in the old one
                rows = [None if m is None else dict(zip(("body", "failure", "message"), m, strict=True)) for m in made]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, kind)], names=["row_", "result_"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return source.mapInArrow(run, schema).select(*[F.col("row_")[c].alias(c) for c in keep], F.col("result_").alias(result))


# --- traces -------------------------------------------------------------------------------------------------------------

EVENT = "struct<seq: int, step: string, input: string, output: string, error: string>"


def as_json(value: object) -> str | None:
    """A copy that is safe to write: what JSON can't say is told by its string form; null stays null."""
    return None if value is None else json.dumps(value, ensure_ascii=False, default=str, sort_keys=True)


def traced(df: DataFrame, key: str, value: str, steps: Mapping[str, Callable[[object], object]]) -> tuple[DataFrame, DataFrame]:
    """(rows, events) of one pass: rows (key, output, failed_step) and events (key, seq, step, input, output, error).

    Steps run in order, each on what the last one gave. Each call is one event, with its input and its output or error; after an
    error the row's later steps aren't called. The pass is written once, and both tables are read from it."""
    source = df.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"))
    none = F.lit(None).cast("string")
    schema = source.select("key", none.alias("output"), none.alias("failed_step"), F.lit(None).cast(f"array<{EVENT}>").alias("events")).schema
    kind = to_arrow_type(schema["events"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, failed, events = [], [], []
            for now in batch.column(1).to_pylist():
                own, at = [], None
                for seq, (name, call) in enumerate(steps.items(), 1):
                    event = {"seq": seq, "step": name, "input": as_json(now), "output": None, "error": None}
                    own.append(event)
                    try:
                        now = call(now)
                        event["output"] = as_json(now)
                    except Exception as e:  # noqa: BLE001 any failure of a step is a result
                        event["error"], now, at = f"{type(e).__name__}: {e}", None, name
                        break
                outputs.append(as_json(now))
                failed.append(at)
                events.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outputs, pa.string()), pa.array(failed, pa.string()), pa.array(events, kind)], names=schema.names)

    done = stored(source.mapInArrow(run, schema))
    return done.select("key", "output", "failed_step"), done.select("key", F.inline("events"))


# --- schedules and fetching ---------------------------------------------------------------------------------------------


def schedule(pages: DataFrame, url: str, host: str, interval: float) -> DataFrame:
    """Pages with `slot`, the gapless number of a page among its host's by URL, and `due`, its earliest second after the
    start, so that a host gets a page each `interval` seconds. Repeated URLs are scheduled once; null hosts are one host."""
    once = pages.dropDuplicates([url])
    return positions(once, [url], [host], "slot").withColumn("due", F.col("slot") * F.lit(float(interval)))


def fetch_pending(
    pages: DataFrame, done_path: str, fetch: Callable[[str], str], url: str = "url", host: str = "host", interval: float = 2.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Fetch the pages that done_path doesn't have yet, and append (url, fetched, content, error) there. Gives all of done_path.

    A page that is there is neither fetched again nor replaced, also if it failed (take failures out of the table to try them again).
    The pages of a host lie in one partition by their slot and are fetched one at a time, `interval` seconds apart by the clock
    of their task: pacing makes a host's pages serial whatever the cluster. Content streams through; nothing is collected."""
    spark = pages.sparkSession
    known = _done(spark, done_path, "url string, fetched double, content string, error string")
    pending = schedule(pages.join(known.select(F.col("url").alias(url)), url, "left_anti"), url, host, interval)
    dealt = pending.select(F.col(url).alias("url"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "slot").repartition("host").sortWithinPartitions("slot", "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wait = last.get(h, float("-inf")) + interval - clock()
                if wait > 0:
                    sleep(wait)
                last[h] = clock()
                content = error = None
                try:
                    content = fetch(u)
                except Exception as e:  # noqa: BLE001 a page that can't be had is a result
                    error = f"{type(e).__name__}: {e}"
                row = {"url": [u], "fetched": [last[h]], "content": pa.array([content], pa.string()), "error": pa.array([error], pa.string())}
                yield pa.RecordBatch.from_pydict(row)

    dealt.mapInArrow(run, "url string, fetched double, content string, error string").write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def _done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one if there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


# --- runs ---------------------------------------------------------------------------------------------------------------


def table_digest(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes): equal for equal tables, in whatever order their rows are."""
    h = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
    return n, int(total)


def resume_run(items: DataFrame, key: str, path: str, answer: Callable[[DataFrame], DataFrame], parts: int = 8, protected: Mapping[str, DataFrame] | None = None, stop_after: int | None = None) -> DataFrame:
    """Answer every item once, part by part, each committed by one append to the table at path; on restart items whose
    records are committed are skipped, so that a run that was stopped ends with the table of one that wasn't. Gives that table.

    answer maps items to their records, which have the items' key. Items of a part are told by the hash of their key. Tables in
    `protected` are digested before and after; a change is an error, which leaves the committed records as they are.
    stop_after ends the run after so many parts, as a failure would."""
    spark = items.sparkSession
    before = {name: table_digest(t) for name, t in (protected or {}).items()}
    schema = answer(items.limit(0)).schema
    for part in range(parts if stop_after is None else min(parts, stop_after)):
        own = items.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        rest = own.join(_done(spark, path, schema).select(key), key, "left_anti")
        answer(rest).write.mode("append").parquet(path)
    changed = [name for name, was in before.items() if table_digest(protected[name]) != was]
    if changed:
        raise ValueError(f"changed during the run: {', '.join(changed)}")
    return _done(spark, path, schema)


def failures(result: Column) -> Column:
    """The failure type of a RESULT, or ok."""
    return F.coalesce(result["failure"], F.when(result.isNotNull(), F.lit("ok")))
