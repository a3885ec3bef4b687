"""Language identification by prediction by partial matching over bytes.

Training counts, for each language, every byte after each context of 0 to ORDER bytes: a context tree. Under the
frozen counts a context with n observations of q different bytes gives a seen byte count / (n + q) and the escape
q / (n + q); an escape goes to the context without its first byte, with the bytes that were seen excluded, and below
the empty context all bytes are equally likely. Every context so has a proper distribution over the 256 bytes, and the
sum of -log2 over a text is its exact code length. The language with the shortest code wins.

All contexts of all languages are numbered once; a table over the last three bytes gives the number of the longest one
that is known, and a table (context, byte, language) the code lengths, so that a batch of whole texts is scored by
array lookups. The model is kept sparse; where the table of all languages would pass CELLS numbers, it is laid out for
some languages at a time, with the same contexts, so that memory is bounded and the code lengths stay the same.

The fit takes a bounded sample of each language, of which there may be any number: the `per_language` labelled texts
that come first in hash order, of at most `text_bytes` bytes each (longer labelled texts are left out), and of all
contexts of this sample the `contexts` most frequent ones over all languages, or all of them where contexts is None.

Defined results: null text, or text without a letter, is `und` with score 0; so is everything if there is nothing to
learn from; ties go to the language first in code point order; rows are predicted one by one, repeated or not; existing
columns of the names that are added are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, has_columns, materialize, widened, worker_cache

ORDER = 3
PER_LANGUAGE = 400
TEXT_BYTES = 65_536
CONTEXTS = 24_000
CELLS = 1 << 26
BROADCAST_LANGUAGES = 100_000
SLICE = 1 << 24
_PAD = b"\n" * ORDER


@dataclass(frozen=True)
class Model:
    """langs in code point order; the kept contexts by (order, context bytes as a number); what was seen after them, as cells
    (context's index, byte, language's index, n)."""

    langs: tuple[str, ...]
    order: np.ndarray
    context: np.ndarray
    cells: np.ndarray  # rows of four

    @classmethod
    def of_grams(cls, langs: tuple[str, ...], grams: np.ndarray, counts: np.ndarray, contexts: int = 24_000) -> Model:
        """From packed (context bytes, byte), four bytes each, and counts, grams x langs."""
        at, lang = np.nonzero(counts)
        rows = [np.stack((np.full(len(at), k), grams[at] >> 8 & ((1 << 8 * k) - 1), grams[at] & 255, lang, counts[at, lang]), axis=1) for k in range(ORDER + 1)]
        cells = np.concatenate(rows).astype(np.int64).reshape(-1, 5)
        pairs, place = np.unique(cells[:, :2], axis=0, return_inverse=True)
        total = np.bincount(place.ravel(), cells[:, 4], len(pairs))
        kept = np.zeros(len(pairs), bool)
        kept[np.lexsort((pairs[:, 1], pairs[:, 0], -total))[:contexts]] = True
        return cls.of_cells(langs, cells[kept[place.ravel()]])

    @classmethod
    def of_cells(cls, langs: tuple[str, ...], cells: np.ndarray) -> Model:
        """cells: rows (order, context, byte, language's index, n)."""
        pairs, place = np.unique(cells[:, :2], axis=0, return_inverse=True)
        return cls(langs, pairs[:, 0], pairs[:, 1], np.column_stack((place.ravel(), cells[:, 2:])))


def _grams(text: bytes) -> np.ndarray:
    """For each byte of the text the four bytes that end with it, as one number."""
    b = np.frombuffer(_PAD + text, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order_by: str = "doc_id", per_language: int = PER_LANGUAGE, text_bytes: int = TEXT_BYTES, contexts: int | None = CONTEXTS) -> Model:
    """Count grams of the sample of docs; rows with null text or language are left out. Without a number of contexts all stay,
    whose number the sample bounds."""
    has_columns(docs, text, lang, order_by)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"), F.xxhash64(order_by, F.lit(7)).alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if sizes.count() <= BROADCAST_LANGUAGES:  # texts then stay where they are; beyond it the languages are joined by hash
        sizes = F.broadcast(sizes)
    # a threshold on the hash leaves about twice the sample, before anything is ranked
    near = rows.join(sizes, "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= 2.0 * per_language / F.col("n") + 50 / F.col("n"))
    first = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("at") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for one in dict.fromkeys(langs.tolist()):
                grams, n = np.unique(np.concatenate([_grams(texts[i]) for i in np.flatnonzero(langs == one)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    sums = first.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    gram = F.col("gram")
    suffixes = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(gram, 8).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("context")) for k in range(ORDER + 1)])
    cells = materialize(sums.select("lang", "n", gram.bitwiseAND(F.lit(255)).alias("byte"), F.inline(suffixes)).groupBy("k", "context", "byte", "lang").agg(F.sum("n").alias("n")))
    # a kept context's suffix is at least as frequent, so it is kept too
    if contexts is not None:
        most = cells.groupBy("k", "context").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k", "context").limit(contexts).select("k", "context")
        cells = cells.join(most, ["k", "context"], "left_semi")
    found = cells.select("k", "context", "byte", "lang", "n").toArrow()
    langs = tuple(sorted(set(found.column("lang").to_pylist()), key=lambda s: s.encode()))
    at = {x: i for i, x in enumerate(langs)}
    lang = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
    return Model.of_cells(langs, np.column_stack([found.column(c).to_numpy() if c != "lang" else lang for c in ("k", "context", "byte", "lang", "n")]).astype(np.int64).reshape(-1, 5))


class Contexts:
    """Lookups that all languages share: the context of the last three bytes, the class of a byte."""

    def __init__(self, model: Model):
        seen = np.unique(model.cells[:, 1])
        self.byte_class = np.full(256, len(seen), np.intp)  # all bytes that were never seen share a class
        self.byte_class[seen] = np.arange(len(seen))
        self.classes = len(seen) + 1
        self.width = np.ones(self.classes)
        self.width[-1] = 256 - len(seen)
        self.longest = np.zeros(1 << 24, np.int32)
        for k in range(ORDER + 1):  # longer contexts overwrite shorter ones
            own = np.flatnonzero(model.order == k)
            self.longest.reshape(-1, 1 << 8 * k)[:, model.context[own]] = own


class Tables:
    """The code lengths in bits of (context, class, language) for the model's languages from lo to before hi."""

    def __init__(self, model: Model, shared: Contexts, lo: int = 0, hi: int | None = None):
        hi = len(model.langs) if hi is None else hi
        self.shared, self.langs = shared, model.langs[lo:hi]
        cells = model.cells[(model.cells[:, 2] >= lo) & (model.cells[:, 2] < hi)]
        cells = cells[np.argsort(cells[:, 0], kind="stable")]
        width = shared.width
        prob = np.empty((len(model.order), shared.classes, hi - lo), np.float32)
        for k in range(ORDER + 1):
            own = np.flatnonzero(model.order == k)
            if k:  # the contexts without their first byte; contexts are in order within each length
                shorter = np.flatnonzero(model.order == k - 1)
                suffix = shorter[np.searchsorted(model.context[shorter], model.context[own] & ((1 << 8 * (k - 1)) - 1))]
            for first in range(0, len(own), 2048):  # bounded memory
                part = own[first : first + 2048]
                s, e = np.searchsorted(cells[:, 0], [part[0], part[-1] + 1])
                c = np.zeros((len(part), shared.classes, hi - lo))
                np.add.at(c, (cells[s:e, 0] - part[0], shared.byte_class[cells[s:e, 1]], cells[s:e, 2] - lo), cells[s:e, 3])
                parent = prob[suffix[first : first + 2048]].astype(float) if k else np.broadcast_to((width / 256)[None, :, None], c.shape)
                prob[part] = blend(c, parent)
        self.bits = np.log2(prob / width[None, :, None].astype(np.float32), out=prob)
        np.negative(prob, out=prob)


def languages_at_once(model: Model, shared: Contexts, cells: int | None = None) -> int:
    return max(1, (cells or CELLS) // max(1, len(model.order) * shared.classes))


def blend(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Distributions (context, class, language) from counts and the distributions of the shorter contexts, with escape
    and exclusion. A context that a language never saw is its shorter context."""
    n, q = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    free = np.where(counts > 0, 0.0, parent)
    left = free.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        escaped = np.where(left > 1e-12, free / left * q / (n + q), 0.0)
        # with every byte seen there is nothing to escape to
        own = np.where(left > 1e-12, counts / (n + q), counts / n)
    return np.where(n > 0, np.where(counts > 0, own, escaped), parent)


def code_lengths(tables: Tables, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language: texts x langs."""
    out = np.zeros((len(texts), len(tables.langs)))
    most = SLICE // max(8, len(tables.langs))
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < most):
            size += len(texts[end]) + ORDER
            end += 1
        b = np.frombuffer(b"".join(_PAD + t for t in texts[at:end]), np.uint8).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum([len(t) + ORDER for t in texts[at:end]])))
        for lo in range(0, len(b), most):
            part = b[max(0, lo - ORDER) : lo + most]
            skip = min(lo, ORDER)
            ctx = np.zeros(len(part) - skip, np.int32)  # the first bytes of all are padding
            ctx[3 - skip :] = tables.shared.longest[part[:-3] << 16 | part[1:-2] << 8 | part[2:-1]]
            bits = tables.bits[ctx, tables.shared.byte_class[part[skip:]]]
            for i in range(end - at):  # the padding of each text bears no code
                s, e = max(starts[i] + ORDER, lo) - lo, min(starts[i + 1], lo + most) - lo
                if s < e:
                    out[at + i] += bits[s:e].sum(axis=0, dtype=np.float64)
        at = end
    return out


def _all_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language of the model. A worker keeps the lookups, and the tables if one holds all languages."""
    kept = worker_cache("langid")
    key = hashlib.blake2b(repr(model.langs).encode() + model.order.tobytes() + model.context.tobytes() + model.cells.tobytes()).digest()
    if kept.get("key") != key:
        kept.clear()
        kept.update(key=key, shared=Contexts(model))
    shared = kept["shared"]
    step = languages_at_once(model, shared)
    if step >= len(model.langs):
        if "tables" not in kept:
            kept["tables"] = Tables(model, shared)
        return code_lengths(kept["tables"], texts)
    return np.hstack([code_lengths(Tables(model, shared, lo, min(lo + step, len(model.langs))), texts) for lo in range(0, len(model.langs), step)])


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs' other columns plus pred and score (the posterior of the winner under equal priors)."""
    has_columns(docs, text)
    keep = [c for c in docs.columns if c != text and c.lower() not in (pred.lower(), score.lower())]
    letters = fresh(docs, "_letters")
    source = widened(docs.select(*keep, F.col(text).cast("binary").alias(fresh(docs, "_text")), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters)))
    schema = source.select(*keep, F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the contexts and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            some = np.flatnonzero(batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)) if model.langs else np.empty(0, int)
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            column = batch.column(len(keep))
            sizes = np.cumsum([column[int(i)].as_buffer().size for i in some])
            for rows in np.split(some, np.flatnonzero(np.diff(sizes // SLICE)) + 1) if len(some) else []:
                bits = _all_lengths(model, [column[int(i)].as_py() for i in rows])
                best = bits.argmin(axis=1)
                lead = bits - bits.min(axis=1, keepdims=True)
                scores[rows] = 1 / np.exp2(-np.minimum(lead, 1000)).sum(axis=1)
                for i, k in zip(rows, best, strict=True):
                    names[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, pred, score])

    return source.mapInArrow(run, schema)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def predict_held_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that aren't held out, predicted for all. A null id
    is held out."""
    model = fit(docs.where(~held_out(doc_id)), text, lang, doc_id)
    return predict(docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")), model)
