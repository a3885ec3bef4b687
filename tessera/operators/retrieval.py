"""Vector top-k and what is built from its results: context, notes, messages, sources.

Vectors and queries are packed into blocks where they are read; blocks meet by a join, and each pair of blocks is multiplied in
numpy. A task keeps the best k of each query before anything is exchanged. vector_index.py searches without all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.store import stored

BLOCK = 4096
BROADCAST_MB = 64
HELD = 2_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(vectors: DataFrame, vector: str) -> DataFrame:
    """Unit vectors; a zero or null vector becomes null."""
    n = norm(F.col(vector))
    return vectors.withColumn(vector, F.when(n > 0, F.transform(vector, lambda x: (x / n).cast("float"))))


def packed(df: DataFrame, key: str, vector: str, rows: int | None = None) -> DataFrame:
    """(width, ids, m): vectors as blocks of at most `rows` unit vectors of equal width, packed where they are read. Null and
    zero vectors, and those with a null, NaN or infinite component, are left out."""
    rows = rows or BLOCK
    source = df.select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v is not null")
    schema = source.select(F.lit(0).alias("width"), F.array("key").alias("ids"), F.lit(b"").alias("m")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), pc.fill_null(vectors.flatten(), np.nan).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for width in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == width)
                m = flat[starts[at][:, None] + np.arange(width)]
                with np.errstate(invalid="ignore", over="ignore"):
                    norm = np.linalg.norm(m, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                m, at = m[good] / norm[good, None], at[good]
                for lo in range(0, len(at), rows):
                    yield block(schema.names, [int(width)], batch.column(0).take(pa.array(at[lo : lo + rows])), m[lo : lo + rows])

    return source.mapInArrow(run, schema)


def block(names: list[str], first: list, ids: pa.Array, m: np.ndarray) -> pa.RecordBatch:
    """One row (*first, ids, m)."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in first], lists, pa.array([m.astype("<f8").tobytes()], pa.binary())], names=names)


def size_mb(blocks: DataFrame) -> float:
    """Of packed vectors."""
    return (blocks.agg(F.sum(F.octet_length("m"))).first()[0] or 0) / 1e6


def nearest_of_blocks(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, key, cosine_distance), best first, from rows (queries, qm, ids, m): a block of queries beside a block of
    vectors. A task keeps the k best of each query over all its rows, up to HELD of them, before anything is exchanged."""
    schema = pairs.select(F.get("queries", F.lit(0)).alias("query_id"), F.get("ids", F.lit(0)).alias("key"), F.lit(0.0).alias("cosine_distance")).schema
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, kept = [], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                asked, qm, ids, m = (batch.column(c)[i] for c in range(4))
                asked, ids = asked.values.to_pandas(), ids.values.to_pandas()
                q, v = (np.frombuffer(x.as_buffer(), "<f8").reshape(n, -1) for x, n in ((qm, len(asked)), (m, len(ids))))
                for lo in range(0, len(q), 512):
                    d = 1.0 - q[lo : lo + 512] @ v.T
                    kth = np.partition(d, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
                    # all that tie with the k-th stay, so that the key can decide
                    row, col = np.nonzero(d <= kth[:, None] + 1e-9)
                    held.append(pd.DataFrame({"query_id": asked.to_numpy()[lo + row], "key": ids.to_numpy()[col], "cosine_distance": d[row, col]}))
                    rows += len(row)
                if rows > max(200_000, 2 * kept):
                    held = [_cut(pd.concat(held), k)]
                    rows = kept = len(held[0])
                if kept > HELD:
                    yield pa.RecordBatch.from_pandas(held[0], arrow, preserve_index=False)
                    held, rows, kept = [], 0, 0
        if held:
            yield pa.RecordBatch.from_pandas(_cut(pd.concat(held), k), arrow, preserve_index=False)

    order = Window.partitionBy("query_id").orderBy(F.round("cosine_distance", 9), "key")
    found = pairs.select("queries", "qm", "ids", "m").mapInArrow(best, schema)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "key", "cosine_distance")


def _cut(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.assign(_d=rows["cosine_distance"].round(9)).sort_values(["query_id", "_d", "key"])
    return rows.groupby("query_id", sort=False).head(k).drop(columns="_d")


def top_k(queries: DataFrame, query_id: str, query_vector: str, vectors: DataFrame, key: str, vector: str, k: int = 3) -> DataFrame:
    """(query_id, rank, key, cosine_distance), best first; ties go to the lesser key. A query finds vectors of its own
    width; zero vectors and nulls neither ask nor are found.

    Exact: every block of queries meets every block of vectors. Vectors are scanned once. Queries are broadcast as packed blocks
    if they measure at most BROADCAST_MB; else vectors are dealt into cells, and queries are copied to each cell."""
    asked = stored(packed(queries, query_id, query_vector).toDF("width", "queries", "qm"))
    blocks = packed(vectors, key, vector)
    if size_mb(asked.select(F.col("qm").alias("m"))) <= BROADCAST_MB:
        return nearest_of_blocks(blocks.join(F.broadcast(asked), "width"), k)
    cells = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.lit(cells)).cast("int"))
    return nearest_of_blocks(dealt.join(asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))), ["width", "cell"]), k)


def embed(df: DataFrame, text: str, vector: str, model: Callable[[list[str]], list[list[float]]], prompt: str = "") -> DataFrame:
    """Unit vectors from an injected model; line breaks become blanks, prompt is put before queries."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for v in model([prompt + (t or "").replace("\n", " ") for t in texts]):
            a = np.asarray(v, np.float64)
            n = np.linalg.norm(a)
            out.append((a / n if n else a).tolist())
        return pd.Series(out)

    return df.withColumn(vector, run(F.col(text)))


def build_store(vectors: DataFrame, path: str, key: str) -> int:
    """Rewrite the store and check it: as many rows as ids, all of them there. Gives the count."""
    vectors.write.mode("overwrite").parquet(path)
    back = vectors.sparkSession.read.parquet(path)
    n, ids = back.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    if n != ids or vectors.select(key).join(back.select(key), key, "left_anti").limit(1).count():
        raise ValueError("the store lacks rows or repeats ids")
    return n


def open_store(spark, path: str) -> DataFrame:
    """Fails on a missing or empty store."""
    try:
        found = spark.read.parquet(path)
    except Exception as e:
        raise FileNotFoundError(f"no store at {path}") from e
    if found.isEmpty():
        raise ValueError(f"the store at {path} is empty")
    return found


def indexable(chunks: DataFrame, roles: tuple[str, ...] = ("content",), role: str = "unit_role") -> tuple[DataFrame, DataFrame]:
    """(chunks of the roles, counts of the others by role)."""
    inside = F.col(role).isin(*roles)
    return chunks.where(inside), chunks.where(~F.coalesce(inside, F.lit(False))).groupBy(role).agg(F.count(F.lit(1)).alias("n"))


def context(results: DataFrame, query: str = "query_id") -> DataFrame:
    """Per query its context blocks, conflict note and source lines.

    results: query, rank, title, document_id, section, place, is_pdf, text, conflict_notes.
    """
    at = F.col("rank").cast("string")
    block = F.concat(F.lit("[Fonte "), at, F.lit("]\nDocumento: "), "title", F.lit(" ("), F.col("document_id").cast("string"), F.lit(")\nSecção: "), "section", F.lit("\n"), F.when(F.col("is_pdf"), "Páginas").otherwise("URL"), F.lit(": "), "place", F.lit("\n\n"), "text")
    where = F.when(F.col("is_pdf"), F.regexp_replace("place", r"^p\. ", "páginas ")).otherwise(F.col("place"))
    line = F.concat(F.lit("- "), "title", F.lit(" ["), F.col("document_id").cast("string"), F.lit("] — "), "section", F.lit(" — "), where)
    note = F.nullif(F.col("conflict_notes"), F.lit(""))
    first_note = F.min("rank").over(Window.partitionBy(query, note))
    first_source = F.min("rank").over(Window.partitionBy(query, "document_id", "section", "place"))
    told = results.withColumn("_b", block).withColumn("_n", F.when(note.isNotNull() & (first_note == F.col("rank")), F.concat(F.lit("- Fonte "), at, F.lit(": "), note))).withColumn("_s", F.when(first_source == F.col("rank"), line))
    joined = lambda c, by: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c].isNotNull()), lambda x: x[c]), by)
    return told.groupBy(query).agg(joined("_b", "\n\n").alias("context"), F.nullif(joined("_n", "\n"), F.lit("")).alias("conflict_note"), joined("_s", "\n").alias("sources"))


def messages(question: Column, context: Column, note: Column) -> Column:
    """The user message."""
    middle = F.when(note.isNotNull(), F.concat(F.lit("[Metadados de curadoria sobre conflitos conhecidos entre fontes]\n"), note, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("CONTEXTO:\n\n"), context, F.lit("\n\n"), middle, F.lit("PERGUNTA:\n\n"), question, F.lit("\n\nResponde apenas com base no contexto acima."))


def older_messages(system: Column, question: Column, context: Column) -> Column:
    """R5, older form: struct<system, user>: the context follows the system's instructions, and the user says the question alone."""
    return F.struct(F.concat(system, F.lit("\n\nCONTEXTO:\n\n"), context).alias("system"), question.alias("user"))


def bare_messages(system: Column, question: Column) -> Column:
    """R5, without retrieval: struct<system, user> of other instructions and the question."""
    return F.struct(system.alias("system"), question.alias("user"))


def available(model: Callable[[str], str], probe: str = "ping") -> str | None:
    """What is wrong with an injected model, or null: it has to answer a probe with a text that isn't blank."""
    try:
        said = model(probe)
    except Exception as e:  # noqa: BLE001 any failure means that it can't be used
        return str(e) or type(e).__name__
    return None if isinstance(said, str) and said.strip() else "empty answer"


def generate(df: DataFrame, prompt: str, answer: str, model: Callable[[str], str]) -> DataFrame:
    """An injected model answers each prompt; a failure gives null and its message in <answer>_error."""

    @F.pandas_udf(f"struct<{answer}:string,{answer}_error:string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for p in prompts:
            try:
                rows.append((model(p), None))
            except Exception as e:  # noqa: BLE001 any failure of the service is a result
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=[answer, f"{answer}_error"])

    return df.withColumn("_a", run(F.col(prompt))).select("*", "_a.*").drop("_a")
