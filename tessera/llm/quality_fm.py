"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs are never visited: for each factor f their sum
is ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2, so that a text costs its distinct features times FACTORS.

Features of a text: each distinct word (lower case, hashed to WORD_BUCKETS) with the square root of its share of the
words; each structure statistic as one indicator of its range (statistics and ranges in STATISTICS), so that its
interactions with words and other statistics are learned range by range; each metadata column as one indicator of its
power of two. Statistics cover the whole text, however long.

The fit takes a bounded sample of labelled rows: the `sample` ids that come first in hash order, of which texts over
`text_bytes` bytes are left out of the fit (and scored like all others). It is Adam over shuffled batches with a fixed
seed, both labels with equal weight in sum, decay on weights and factors. Features of the sample are computed by Spark; the
driver gets two numbers for each distinct word of each text of the sample.

Defined results: null and empty texts have no words, and statistics of 0, and are scored like others; null labels and
labels other than 0 and 1 are left out; a document with labels that differ counts once with each; of rows that repeat an
id the fit takes the least text; without both labels all scores are the share of label 1 (0.5 without labels); rows are
scored one by one, repeated or not; existing columns of the names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, fresh, has_columns, release_memory, slices, widened, worker_cache

WORD_BUCKETS = 1 << 15
FACTORS = 8
SAMPLE = 6_000
TEXT_BYTES = 32_768
EPOCHS = 12
BATCH = 64
RATE = 0.02
DECAY = 1e-3
META_LEVELS = 64

#: name and ascending bounds of its ranges; a value belongs to the range of the bounds at or below it
STATISTICS = (
    ("words", (1, 5, 20, 50, 100, 300, 1000, 3000, 10000)),
    ("characters a word", (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 15.0)),
    ("share of letters", (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)),
    ("share of capitals among letters", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    ("share of digits", (0.005, 0.02, 0.05, 0.1, 0.2)),
    ("symbols a word", (0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    ("bars a word", (0.005, 0.02, 0.05, 0.1, 0.2, 0.5)),
    ("exclamation marks a word", (0.005, 0.02, 0.05, 0.1, 0.3, 0.7)),
    ("stops a word", (0.01, 0.03, 0.06, 0.1, 0.2, 0.4)),
    ("words a line", (1.5, 3.0, 6.0, 12.0, 25.0, 50.0, 100.0)),
    ("repeated words beside each other", (0.005, 0.02, 0.05, 0.1, 0.3, 0.6)),
    ("distinct words by their root", (0.3, 0.6, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)),
)
_WIDTH = 1 + max(len(b) for _, b in STATISTICS)


def buckets(words: int = WORD_BUCKETS, metadata: int = 0) -> int:
    return words + _WIDTH * len(STATISTICS) + META_LEVELS * metadata


@dataclass(frozen=True)
class Model:
    """w0, w (buckets) and v (buckets x factors), for so many buckets of words."""

    words: int
    metadata: tuple[str, ...]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, from features (text, bucket, value) sorted by text: the probability of label 1."""
        return sigmoid(self.w0 + raw_score(self.w, self.v, doc, feature, value, n)[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _by_text(values: np.ndarray, starts: np.ndarray, n: int, texts: np.ndarray) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    if len(starts):
        out[texts] = np.add.reduceat(values, starts, axis=0)
    return out


def raw_score(w: np.ndarray, v: np.ndarray, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(linear part and pairs of each text, the sums of v x by text and factor), in time of features x factors."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    texts = doc[starts]
    vx = v[feature] * value[:, None]
    sums = _by_text(vx, starts, n, texts)
    squares = _by_text(np.square(vx), starts, n, texts)
    return _by_text(w[feature] * value, starts, n, texts) + 0.5 * (np.square(sums) - squares).sum(axis=1), sums


def statistic_columns(text: Column) -> list[Column]:
    """The counts of a text that STATISTICS need beside its words, by built-in functions over the whole text."""
    n = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
    patterns = (r"\p{L}", r"\p{Lu}", r"\p{Nd}", r"[#*$%&<>@^~=_\\{}\[\]]", r"\|", "!", r"[.?]", r"\n")
    return [F.coalesce(F.char_length(F.regexp_replace(text, SPACE, "")), F.lit(0)), *[n(p) for p in patterns]]


def statistics(counts: np.ndarray, words: np.ndarray, distinct: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """texts x STATISTICS, from texts x statistic_columns and the numbers of words, distinct words and words equal to the one before."""
    chars, letters, capitals, digits, symbols, bars, marks, stops, breaks = counts.T.astype(np.float64)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack((words, chars / w, letters / c, capitals / np.maximum(letters, 1), digits / c, symbols / w, bars / w, marks / w, stops / w, words / (breaks + 1), repeats / w, distinct / np.sqrt(w)), axis=1)


def _indicators(stats: np.ndarray, metadata: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the statistics' ranges, and of the powers of two of metadata (NaN: none)."""
    n, k = stats.shape
    at = np.stack([np.searchsorted(b, stats[:, j], side="right") for j, (_, b) in enumerate(STATISTICS)], axis=1)
    docs = [np.repeat(np.arange(n), k)]
    cols = [(words + np.arange(k) * _WIDTH + at).ravel()]
    for j in range(metadata.shape[1]):
        some = np.flatnonzero(~np.isnan(metadata[:, j]))
        level = np.log2(np.clip(metadata[some, j], 0, 2.0 ** (META_LEVELS - 2)) + 1).astype(int)
        docs.append(some)
        cols.append(words + k * _WIDTH + j * META_LEVELS + level)
    d = np.concatenate(docs)
    return d, np.concatenate(cols), np.full(len(d), 1 / np.sqrt(k))


def _features(part: pa.RecordBatch, words: int, n_meta: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value), sorted by text, of rows (text, counts..., metadata...)."""
    n = part.num_rows
    split = pc.ascii_split_whitespace(pc.fill_null(part.column(0).cast(pa.large_string()), ""))
    offsets = split.offsets.to_numpy()
    flat = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), np.diff(offsets))[real]
    known = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh64_intdigest(w.lower()) % words for w in known.dictionary.to_pylist()), np.int64, len(known.dictionary))
    codes = known.indices.to_numpy(zero_copy_only=False)[real]
    ids = table[codes] if len(codes) else np.zeros(0, np.int64)
    pairs, count = np.unique(owner * words + ids, return_counts=True)
    doc, bucket = pairs // words, pairs % words
    size = np.bincount(owner, minlength=n)
    same = np.flatnonzero((codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]))
    counts = np.stack([part.column(1 + j).to_numpy(zero_copy_only=False) for j in range(9)], axis=1)
    stats = statistics(counts, size, np.bincount(doc, minlength=n), np.bincount(owner[1:][same], minlength=n))
    meta = np.stack([pc.fill_null(part.column(10 + j), np.nan).to_numpy(zero_copy_only=False) for j in range(n_meta)], axis=1) if n_meta else np.zeros((n, 0))
    d, b, x = _indicators(stats, meta, words)
    doc, bucket, value = np.concatenate((doc, d)), np.concatenate((bucket, b)), np.concatenate((np.sqrt(count / size[doc]), x))
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order], value[order]


def _inputs(docs: DataFrame, keep: list[Column], text: str, metadata: tuple[str, ...]) -> DataFrame:
    names = iter(range(1 << 30))
    t = F.col(text)
    inputs = [t.cast("string"), *[c.cast("long") for c in statistic_columns(t)], *[F.col(m).cast("double") for m in metadata]]
    return docs.select(*[c.alias(f"in{next(names)}") for c in inputs], *keep)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE, text_bytes: int = TEXT_BYTES, words: int = WORD_BUCKETS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Learn from the labelled rows of docs; ids join them and order the sample, and are no inputs."""
    has_columns(docs, doc_id, text, *metadata)
    has_columns(labels, doc_id, label)
    y = F.col(label).cast("double")
    told = labels.where(y.isin(0.0, 1.0)).select(F.col(doc_id).alias("label_id"), y.alias("y"), F.xxhash64(F.col(doc_id).cast("string"), F.lit(seed)).alias("h")).distinct()
    # ids and labels are ranked and bounded before any text is read
    first = told.join(docs.select(F.col(doc_id).alias("label_id")), "label_id", "left_semi").orderBy("h", "label_id", "y").limit(sample)
    own = F.struct(F.col(text).cast("string").alias("text"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)])
    near = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= text_bytes).select(F.col(doc_id).alias("label_id"), own.alias("own")).join(F.broadcast(first), "label_id")
    # one row an id and label, however often an id is repeated
    rows = near.groupBy("h", "label_id", "y").agg(F.min("own").alias("own")).select("h", "y", "own.*")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_fm")
        at = 10 + len(metadata)
        for batch in batches:
            for part in slices(batch, 0):
                doc, bucket, value = _features(part, words, len(metadata))
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(at), part.column(at + 1), *lists], names=["h", "y", "bucket", "value"])

    found = _inputs(rows, [F.col("h"), F.col("y")], "text", tuple(f"m{i}" for i in range(len(metadata)))).mapInArrow(extract, "h long, y double, bucket array<int>, value array<float>")
    got = found.toArrow().sort_by([("h", "ascending"), ("y", "ascending")])  # at most `sample` rows
    bucket, value = (pa.concat_arrays(got.column(c).chunks) if len(got) else pa.array([], pa.list_(pa.float32())) for c in ("bucket", "value"))
    sizes = pc.list_value_length(bucket).to_numpy(zero_copy_only=False).astype(int)
    return train(got.column("y").to_numpy(), sizes, bucket.flatten().to_numpy(), value.flatten().to_numpy(), words, metadata, factors, epochs, seed)


def train(y: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, value: np.ndarray, words: int = WORD_BUCKETS, metadata: tuple[str, ...] = (), factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7, batch: int = BATCH, rate: float = RATE, decay: float = DECAY) -> Model:
    """Adam over batches of texts, given by their sizes in features; each label weighs half of all."""
    n = buckets(words, len(metadata))
    dice = np.random.default_rng(seed)
    v = dice.normal(0, 0.05, (n, factors))
    params = [np.zeros(1), np.zeros(n), v]
    ones = y.mean() if len(y) else 0.5
    if len(y) == 0 or ones in (0.0, 1.0):
        share = np.clip(ones, 1e-6, 1 - 1e-6)
        return Model(words, tuple(metadata), float(np.log(share / (1 - share))), np.zeros(n), np.zeros((n, factors)))
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones))
    ends = np.cumsum(sizes)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = dice.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            at = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in rows])
            doc, feature, x = np.repeat(np.arange(len(rows)), sizes[rows]), bucket[at], value[at]
            raw, sums = raw_score(params[1], params[2], doc, feature, x, len(rows))
            miss = (sigmoid(params[0][0] + raw) - y[rows]) * weight[rows] / len(rows)
            used, place = np.unique(feature, return_inverse=True)
            gx = miss[doc] * x
            gw = np.bincount(place, gx, len(used)) + decay * params[1][used] / len(rows)
            pair = gx[:, None] * (sums[doc] - params[2][feature] * x[:, None])
            gv = np.stack([np.bincount(place, pair[:, f], len(used)) for f in range(factors)], axis=1) + decay * params[2][used] / len(rows)
            step += 1
            for p, (m, s), g, rows_of in zip(params, moments, (miss.sum(keepdims=True), gw, gv), (slice(None), used, used), strict=True):
                m[rows_of] = 0.9 * m[rows_of] + 0.1 * g
                s[rows_of] = 0.999 * s[rows_of] + 0.001 * np.square(g)
                p[rows_of] -= rate * (m[rows_of] / (1 - 0.9**step)) / (np.sqrt(s[rows_of] / (1 - 0.999**step)) + 1e-8)
    return Model(words, tuple(metadata), float(params[0][0]), params[1], params[2])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs' other columns than text plus the score, and predicted (1 from 0.5 on)."""
    has_columns(docs, text, *model.metadata)
    names = [c for c in docs.columns if c != text and c.lower() not in (out.lower(), "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x (factors + 1) numbers
    n_meta = len(model.metadata)
    # passed as one struct, so that no name can clash with those of the inputs
    row, keep = "row", F.struct(F.lit(0).alias(fresh(docs, "_")), *[F.col(c) for c in names])
    source = _inputs(widened(docs), [keep.alias(row)], text, model.metadata)
    schema = source.select(row, F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_fm")
        model = shared.value
        for batch in batches:
            for part in slices(batch, 0):
                p = model.score(*_features(part, model.words, n_meta), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(10 + n_meta), pa.array(p)], names=[row, "score"])
        release_memory()

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col(row)[c].alias(c) for c in names], F.col("score").alias(out), (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def score_held_out(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), **parameters: int) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the rows that aren't held out, scored for all. A null id is held out."""
    model = fit(docs.where(~held_out(doc_id)), labels, doc_id, text, label, metadata, **parameters)
    own = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"), *[F.col(m).alias(m) for m in metadata])
    return score(own, model).select("doc_id", "held_out", "score", "predicted")
