"""Stupid-backoff language-model scores from the corpus's own n-gram counts, computed by joins.

S(w | context) is count(context w) / count(context) where the n-gram occurs min_count times or more, and otherwise
alpha * S(w | shorter context), down to count(w) / words. A text's score is the sum of ln S over its words, each
rounded to a millionth so that sums agree in any order.

Texts are read once and kept as blocks of about BLOCK words. Orders follow one another. Each block explodes its n-grams
of an order, once each; rows are dealt out by the n-gram's hash, where a window over equal n-grams counts them in all
blocks, and those from min_count on (words always) go back and are joined to their block. There the next order is
exploded only where both halves of an n-gram occur min_count times or more, as it can't occur more often than they do:
nothing is lost, and of natural text most n-grams are not moved. A block's counts give its texts' scores, since the
context of an n-gram is the shorter one that ends a word before.

An n-gram is a 64-bit hash of its two halves (the n-grams without its last and its first word). Two of g n-grams share a
hash with probability g^2 / 2^65, and are then counted as one.

No key is hot: an n-gram has one row a block, and a block is bounded. Disk: an order longer than one word is counted in
PASSES parts by hash range, whose shuffles are dropped before the next; a block's earlier form goes when it is rewritten.
Rows, counts and blocks all grow in proportion to the words.

count_tables and weights give the same model as tables, for texts that aren't in the corpus.

Defined results: null and empty texts have no words and score 0; words are runs of non-blank characters, case as it
is; repeated rows are documents of their own and add to the counts; ids may be of any type; an empty table gives an
empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import appended, discard, has_columns, materialize, release_memory, widened, worker_cache

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
BLOCK = 1_000_000
PASSES = 3
PACKED = 2_000_000  # counts that a task packs at once
_TEXTS = 1 << 16  # texts of a block at most: 16 bits of a document's number
_LEVELS = 8
_SLICE = 1 << 13  # n-grams hashed at once
_ZIP = zstandard.ZstdCompressor(3)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # constants of XXH64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """XXH64 of eight bytes."""
    h = (seed + _P5 + np.uint64(8)) ^ _turn(x * _P2, 31) * _P1
    h = _turn(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def join_halves(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """What F.xxhash64(prefix, suffix) gives for two longs. Slices keep the many intermediate arrays in the processor's cache."""
    out = np.empty(len(prefix), np.uint64)
    for lo in range(0, len(out), _SLICE):
        cut = slice(lo, lo + _SLICE)
        out[cut] = _hash_long(suffix[cut], _hash_long(prefix[cut], np.uint64(42)))
    return out


def gram_hashes(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 1 to order: (positions of words that end a k-gram inside their text, its hash, its prefix, its suffix)."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, h = np.arange(len(words)), words
    yield at, h, h, np.zeros_like(h)
    for k in range(2, order + 1):
        full = np.zeros(len(words), np.uint64)
        full[at] = h
        at = np.flatnonzero(place >= k - 1)
        prefix, suffix = full[at - 1], full[at]
        h = join_halves(prefix, suffix)
        yield at, h, prefix, suffix


def _planes(values: np.ndarray, width: int = 4) -> bytes:
    """Numbers of so many bytes, byte by byte and compressed: the upper bytes are nearly all zero."""
    return _ZIP.compress(np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def _from_planes(data: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def text_blocks(docs: DataFrame, doc_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """(block, n_words, ids, sizes, vocab, codes): texts as positions in a block's own list of word hashes."""
    rows = widened(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    schema = rows.select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("n_words"), F.array("doc_id").alias("ids"), *[F.lit(b"").alias(c) for c in ("sizes", "vocab", "codes")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lm_score")
        number = TaskContext.get().partitionId() << 22
        ids, sizes, hashes, count, texts = [], [], [], 0, 0

        def made() -> pa.RecordBatch:
            vocab, codes, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get the low numbers, whose upper bytes are zero
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = pa.concat_arrays(ids)
            cols = [pa.array([number]), pa.array([count]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            cols += [pa.array([x], pa.binary()) for x in (_planes(np.concatenate(sizes)), vocab[order].astype("<u8").tobytes(), _planes(rank[codes]))]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                words = pc.ascii_split_whitespace(pc.fill_null(part.column(1).cast(pa.large_string()), ""))
                offsets = words.offsets.to_numpy()
                flat = words.values.slice(offsets[0], offsets[-1] - offsets[0])
                real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                known = flat.dictionary_encode()
                table = np.fromiter((xxhash.xxh64_intdigest(w) for w in known.dictionary.to_pylist()), np.uint64, len(known.dictionary))
                hashes.append(table[known.indices.to_numpy(zero_copy_only=False)][real])
                sizes.append(np.diff(np.concatenate(([0], np.cumsum(real)))[offsets - offsets[0]]))
                ids.append(part.column(0))
                count += len(hashes[-1])
                texts += part.num_rows
                if count >= block or texts > _TEXTS - 1000:
                    yield made()
                    ids, sizes, hashes, count, texts, number = [], [], [], 0, 0, number + 1
        if ids:
            yield made()
        release_memory()

    return rows.mapInArrow(run, schema)


def _block(sizes: bytes, vocab: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(vocab, "<u8")[_from_planes(codes)], _from_planes(sizes).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, words, sizes, *others) of rows (block, sizes, vocab, codes, *others)."""
    for batch in batches:
        for i in range(batch.num_rows):
            number, *packed = (batch.column(c)[i].as_py() for c in range(4))
            yield (number, *_block(*packed), *(batch.column(c)[i] for c in range(4, batch.num_columns)))


def _in_pass(grams: np.ndarray, turn: int, passes: int) -> np.ndarray:
    return (grams >> np.uint64(32)) % np.uint64(passes) == turn


def _column_in_pass(gram: str, turn: int, passes: int) -> Column:
    return F.shiftrightunsigned(gram, 32) % passes == turn


def _counted(order: int, turn: int, passes: int):
    """mapInArrow body: the n-grams of each block, once each with its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lm_score")
        for _, words, sizes in _blocks(batches):
            for k, (_, grams, prefix, suffix) in enumerate(gram_hashes(words, sizes, order), 1):
                mine = _in_pass(grams, turn, passes)
                _, first, n = np.unique(grams[mine], return_index=True, return_counts=True)
                cols = [np.full(len(first), k, np.int8), prefix[mine][first].view(np.int64), suffix[mine][first].view(np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k", "prefix", "suffix", "n"])
        release_memory()

    return run


def count_tables(blocks: DataFrame, order: int, min_count: int = MIN_COUNT, passes: int = PASSES) -> DataFrame:
    """(k, prefix, suffix, n) of all words (prefix) and of longer n-grams that occur min_count times or more."""
    own = blocks.select("block", "sizes", "vocab", "codes")

    def part(turn: int) -> DataFrame:
        rows = own.mapInArrow(_counted(order, turn, passes), "k byte, prefix long, suffix long, n long")
        return rows.groupBy("k", "prefix", "suffix").agg(F.sum("n").alias("n")).where((F.col("k") == 1) | (F.col("n") >= min_count))

    return appended(part(turn) for turn in range(passes))


def weights(counts: DataFrame, order: int, words_all: int, alpha: float = ALPHA, passes: int = PASSES) -> DataFrame:
    """(gram, n, w0, w1, ...): what an n-gram adds to a text, in millionths, where it could be lengthened by 0, 1, ... words
    more within the order and the text, each of which was backed off from. Longer n-grams are joined in parts, too."""

    def backed_off(value: Column, times: int) -> Column:
        for _ in range(times):
            value = F.lit(log(alpha)) + value
        return value

    micro = lambda v: F.rint(v * 1e6).cast("long")
    made, written, below = [], [], None
    for k in range(1, order + 1):
        own = counts.where(F.col("k") == k)
        if k == 1:
            rows = own.select(F.col("prefix").alias("gram"), "n", F.log(F.col("n") / F.lit(float(words_all))).alias("value"), F.lit(None).cast("double").alias("less"))
            rows = materialize(rows)
        else:
            context, shorter = below.select(F.col("gram").alias("prefix"), F.col("n").alias("context")), below.select(F.col("gram").alias("suffix"), F.col("value").alias("less"))

            def part(turn: int, own: DataFrame = own, context: DataFrame = context, shorter: DataFrame = shorter) -> DataFrame:
                mine = own.select(F.xxhash64("prefix", "suffix").alias("gram"), "prefix", "suffix", "n").where(_column_in_pass("gram", turn, passes))
                return mine.join(context, "prefix").join(shorter, "suffix").select("gram", "n", F.log(F.col("n") / F.col("context")).alias("value"), "less")

            rows = appended(part(turn) for turn in range(passes))
        levels = [micro(backed_off(F.col("value"), i)) - (micro(backed_off(F.col("less"), i + 1)) if k > 1 else 0) for i in range(order - k + 1)]
        levels += [F.lit(None).cast("long")] * (k - 1)
        made.append(rows.select("gram", "n", *[c.cast("int").alias(f"w{i}") for i, c in enumerate(levels)]))
        written.append(rows)
        below = rows
    table = appended(made)
    for rows in written:  # the orders' own tables would lie on disk through all parts of the scoring
        discard(rows)
    return table


def _runs(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the order of the n-grams, where each run of equal ones starts there, its length)."""
    rank = np.argsort(grams)
    known = grams[rank]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(known)), bool), known[1:] != known[:-1])))
    return rank, starts, np.diff(starts, append=len(known))


def _open_grams(words: np.ndarray, k: int, opened: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last word, hash) of the k-grams whose halves are both kept; these lie within a text."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(opened, np.uint8), count=len(words)))
    shorter = words
    for _ in range(k - 2):
        shorter = join_halves(shorter[:-1], shorter[1:])
    return at, join_halves(shorter[at - k + 1], shorter[at - k + 2])


def _exploded(k: int, turn: int, passes: int):
    """mapInArrow body: the k-grams of each block that may be kept, once each with a place and their number there. A word's
    place is that in the block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lm_score")
        for batch in batches:
            for row in range(batch.num_rows):
                number, sizes, vocab, codes, opened = (batch.column(c)[row].as_py() for c in range(5))
                words, _ = _block(sizes, vocab, codes)
                if k == 1:
                    grams = np.frombuffer(vocab, "<u8")
                    n = np.bincount(_from_planes(codes), minlength=len(grams))
                    at = np.flatnonzero(_in_pass(grams, turn, passes))
                    grams, n = grams[at], n[at]
                else:
                    at, grams = _open_grams(words, k, opened)
                    mine = _in_pass(grams, turn, passes)
                    at, grams = at[mine], grams[mine]
                    rank, starts, n = _runs(grams)
                    at, grams = at[rank[starts]], grams[rank[starts]]
                cols = [grams.view(np.int64), np.full(len(at), number), at, n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["gram", "block", "place", "n"])
        release_memory()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: (block, place, total) as one row a block, of rising places and their totals."""
    worker_cache("lm_score")
    held, rows = [], 0

    def made() -> pa.RecordBatch:
        block, place, total = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
        rank = np.lexsort((place, block))
        block, place, total = block[rank], place[rank], total[rank]
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        parts = [(block[lo], _planes(np.diff(place[lo:hi], prepend=0)), _planes(total[lo:hi], 8)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*parts, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "places", "totals"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACKED:
            yield made()
            held, rows = [], 0
    if rows:
        yield made()
    release_memory()


def _counts_of(k: int, words: np.ndarray, n_vocab: int, opened: bytes, counted: pa.Table) -> np.ndarray:
    """What came back for a block: the count of each word of its list, or of the k-gram that ends at each place (0: not kept)."""
    totals = np.zeros(n_vocab if k == 1 else len(words), np.int64)
    for places, n in zip(counted.column("places").to_pylist(), counted.column("totals").to_pylist(), strict=True):
        totals[np.cumsum(_from_planes(places), dtype=np.int64)] = _from_planes(n, 8)
    if k > 1:  # one place of each n-gram was sent
        at, grams = _open_grams(words, k, opened)
        rank, starts, n = _runs(grams)
        if len(starts):
            at = at[rank]
            totals[at] = np.repeat(np.maximum.reduceat(totals[at], starts), n)
    return totals


def _with_counts(k: int, order: int, words_all: int, alpha: float, min_count: int):
    """Cogrouped body: a block with its counts of order k, and after the last order its texts' scores."""

    def run(block: pa.Table, counted: pa.Table) -> pa.Table:
        worker_cache("lm_score")
        sizes, vocab, codes, opened, counts = (block.column(c)[0].as_py() for c in ("sizes", "vocab", "codes", "opened", "counts"))
        sizes, codes = _from_planes(sizes).astype(np.int64), _from_planes(codes)
        words = np.frombuffer(vocab, "<u8")[codes]
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = _counts_of(k, words, len(vocab) // 8, opened, counted)
        if k < order:
            enough = (own[codes] if k == 1 else own) >= min_count
            both = enough & (place >= k)
            both[1:] &= enough[:-1]
            release_memory()
            columns = block.select(["block", "ids", "sizes", "vocab", "codes"])
            return columns.append_column("counts", pa.array([[*counts, _planes(own, 8)]], pa.list_(pa.binary()))).append_column("opened", pa.array([np.packbits(both).tobytes()], pa.binary()))
        totals = [*(_from_planes(c, 8).astype(np.int64) for c in counts), own]
        shorter = totals[0][codes]
        value = np.log(shorter / words_all)
        for j, total in enumerate(totals[1:], 1):
            kept = np.flatnonzero(total)
            longer = np.where(place >= j, log(alpha) + value, value)
            longer[kept] = np.log(total[kept] / shorter[kept - 1])
            value, shorter = longer, total
        micro, ends = np.concatenate(([0], np.cumsum(np.rint(value * 1e6).astype(np.int64)))), np.cumsum(sizes)
        release_memory()
        return pa.table([block.column("ids")[0].values, pa.array(sizes), pa.array((micro[ends] - micro[ends - sizes]) / 1e6)], names=["doc_id", "n_words", "score"])

    return run


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, block: int = BLOCK, passes: int = PASSES, frequent: int | None = None) -> DataFrame:
    """(doc_id, n_words, score) for each row. `frequent` is taken as before, but has no use now that no key is hot."""
    has_columns(docs, doc_id, text)
    if not 1 <= order <= _LEVELS:
        raise ValueError(f"the order must be 1 to {_LEVELS}")
    blocks = materialize(text_blocks(docs, doc_id, text, block))
    words_all = blocks.agg(F.sum("n_words")).first()[0] or 0
    schema = docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("score")).schema
    known = blocks.drop("n_words").select("*", F.array().cast("array<binary>").alias("counts"), F.lit(b"").alias("opened"))

    def counted(k: int, turn: int, turns: int) -> DataFrame:
        rows = known.select("block", "sizes", "vocab", "codes", "opened").mapInArrow(_exploded(k, turn, turns), "gram long, block long, place long, n long")
        rows = rows.withColumn("total", F.sum("n").over(Window.partitionBy("gram")))
        kept = rows if k == 1 else rows.where(F.col("total") >= min_count)
        return kept.select("block", "place", "total").mapInArrow(_packed, "block long, places binary, totals binary")

    for k in range(1, order + 1):
        turns = 1 if k == 1 else passes  # of words, a block has few different ones
        found = appended(counted(k, turn, turns) for turn in range(turns))
        made = known.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_with_counts(k, order, words_all, alpha, min_count), schema if k == order else known.schema)
        if k < order:
            made = materialize(made)
            for done in (known, found):
                discard(done)
            known = made
    return made
