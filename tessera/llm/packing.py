"""Vector bin packing of examples into sequences, by the dot-product heuristic.

An example asks for a vector of tokens, segments and loss-bearing tokens; a sequence offers one of capacities. The open
sequence takes, of the pieces that fit, the one whose request has the greatest dot product with what is left of it
(both as shares of the capacities), until none fits; a piece that is cut then fills what is left. Examples longer
than a sequence give whole sequences first, and only their rests are packed. A sequence that stays short at the end
of a group is cut into powers of two, which are not padded.

Packing is local: each task packs its rows in groups of bounded size, without a shuffle. Sequence ids hold the
partition in their upper bits. They are stable for the same input partitions.

Defined results: null text is an empty one and still ends with the end id, so that every row gives a piece; rows of
equal ids are packed on their own; an empty table gives an empty one; other columns are not read, whatever their names.
An example that no sequence can hold has null as sequence_id and offset. A tokenizer whose ids of a whole text aren't
those of its words raises ValueError.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, has_columns, release_memory, slices, widened, worker_cache

GROUP_TOKENS = 2_000_000
CACHE_WORDS = 450_000
SLICE_BYTES = 4_000_000


PROBES = ("", "Two words", "A  b\n\nc\td ", " lead, trail. ", "It's YOU'RE e.g. x_y 12,345.60!", "Ünï ÉCOLE ß (q)", "a-b/c: #d; 'e' \"f\"?!")


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 1024
    loss_tokens: int = 4096


class WordTokenizer:
    """Ids of whole texts for a tokenizer that lowers case and drops white space, with the ids of each word kept.

    Neither its normalizer nor its splits reach over ASCII blanks, nor over the border between a letter or digit and
    the punctuation that ends a word, so that words and such ends are encoded by themselves. The store is emptied when
    it is full, so that memory is bounded.
    """

    END = ".,!?;:"
    SEPARATOR = "|"

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only hold memory of their own
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), end_id
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)  # without places in the text
        self.separator = self.tok.encode(self.SEPARATOR, add_special_tokens=False).ids
        self._empty()
        ids, sizes = self(pa.array(PROBES))
        for text, own in zip(PROBES, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            if own.tolist() != [*self.tok.encode(text, add_special_tokens=False).ids, end_id]:
                raise ValueError(f"{path}: the ids of a whole text aren't those of its words (at {text!r})")

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.lens = np.empty(1 << 14, np.int32)

    def _keep(self, words: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        n = len(self.known)
        while n + len(words) > len(self.lens):
            self.lens = np.concatenate((self.lens, np.empty_like(self.lens)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.lens[n : n + len(words)] = lens
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _encode(self, words: list[str]) -> None:
        """Many words in one text, parted by a word of one id; one by one where that could go wrong."""
        alone = [w for w in words if self.SEPARATOR in w or not w]
        joined = [w for w in words if self.SEPARATOR not in w and w] if len(self.separator) == 1 else []
        groups = [joined[i : i + 400] for i in range(0, len(joined), 400)]
        for lo in range(0, len(groups), 20):
            part = groups[lo : lo + 20]
            for group, e in zip(part, self.encode([f" {self.SEPARATOR} ".join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == self.separator[0])
                if len(cuts) == len(group) - 1:
                    self._keep(group, np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                else:
                    alone += group
        if len(self.separator) != 1:
            alone = words
        for lo in range(0, len(alone), 1000):
            part = alone[lo : lo + 1000]
            ids = [e.ids for e in self.encode(part, add_special_tokens=False)]
            self._keep(part, np.array([x for own in ids for x in own], np.uint32), np.fromiter(map(len, ids), np.int32, len(ids)))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Numbers of the words in the store, which takes in those that are new."""
        each = words.dictionary_encode()
        vocab = each.dictionary.to_pylist()
        new = [w for w in vocab if w not in self.known]
        if new:
            self._encode(new)
        known = self.known
        return np.fromiter(map(known.__getitem__, vocab), np.int32, len(vocab))[each.indices.to_numpy(zero_copy_only=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of all texts, each with its end id, and their numbers."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = words.offsets.to_numpy()
        flat = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        vocab = flat.dictionary
        if len(self.known) + len(vocab) > CACHE_WORDS:
            self._empty()
        # special tokens are matched before case is lowered
        low = pc.if_else(pc.match_substring(vocab, "<|"), vocab, pc.ascii_lower(vocab))
        core = pc.utf8_rtrim(low, characters=self.END)
        core = pc.if_else(pc.match_substring_regex(core, r"[\p{L}\p{N}]$"), core, low)
        pairs = np.empty((len(vocab), 2), np.int32)
        pairs[:, 0], pairs[:, 1] = self._places(core), self._places(_tails(low, core))
        starts = np.concatenate(([0], np.cumsum(self.lens[: len(self.known)]))).astype(np.int32)  # a slice has far fewer than 2^31 ids
        codes = pairs[flat.indices.to_numpy(zero_copy_only=False)].ravel()
        # after each text comes the end id, which stands behind the store
        finish = len(self.known)
        lens = np.append(self.lens[:finish], np.int32(1))
        pool = np.append(self.pool[: self.used], np.uint32(self.end))
        codes = np.insert(codes, 2 * (offsets[1:].astype(np.int64) - offsets[0]), finish)
        n = lens[codes]
        after = np.cumsum(n, dtype=np.int32)
        ids = pool[np.arange(after[-1] if len(after) else 0, dtype=np.int32) + np.repeat(starts[codes] - after + n, n)]
        ends = 2 * (offsets[1:].astype(np.int64) - offsets[0]) + np.arange(len(offsets) - 1)
        return ids, np.diff(np.concatenate(([0], after[ends])))


def _tokenizer(path: str, end_id: int) -> WordTokenizer:
    """One in each Python worker, which keeps its words from task to task."""
    kept = worker_cache("packing")
    if (path, end_id) not in kept:
        kept.clear()
        kept[path, end_id] = WordTokenizer(path, end_id)
    return kept[path, end_id]


def _tails(whole: pa.Array, head: pa.Array) -> pa.Array:
    """What whole has after head."""
    whole, head = whole.cast(pa.large_binary()), head.cast(pa.large_binary())
    offsets = whole.buffers()[1]
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    sizes = pc.subtract(pc.binary_length(whole), pc.binary_length(head)).to_numpy()
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    after = np.concatenate(([0], np.cumsum(sizes)))
    take = data[np.arange(after[-1]) + np.repeat(ends[1:] - after[1:], sizes)]
    return pa.Array.from_buffers(pa.large_string(), len(whole), [None, pa.py_buffer(after.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(take))])


def pack(pieces: list[tuple], limits: Limits, cut: bool = True) -> list[list[tuple]]:
    """Sequences of pieces (key, start, length, loss tokens, segments), by the dot-product heuristic.

    cut: pieces of one segment may be divided (their loss tokens are then taken to lie evenly).
    """
    cap = (limits.tokens, limits.loss_tokens, limits.segments)
    shelves: dict[tuple[int, int, int], list[tuple]] = defaultdict(list)
    done: list[list[tuple]] = []
    for p in pieces:
        key, start, n, loss, segments = p
        while cut and segments == 1 and n >= limits.tokens and loss <= n:
            part = -(-loss * limits.tokens // n)
            if part > limits.loss_tokens:
                break
            done.append([(key, start, limits.tokens, part, 1)])
            start, n, loss = start + limits.tokens, n - limits.tokens, loss - part
        if n:
            if n > cap[0] or loss > cap[1] or segments > cap[2]:
                raise ValueError(f"piece {key!r} exceeds the limits of a sequence")
            shelves[n, loss, segments].append((key, start, n, loss, segments))
    kinds = np.array(sorted(shelves), np.int64).reshape(-1, 3)  # columns: tokens, loss, segments
    left = np.array([len(shelves[tuple(k)]) for k in kinds.tolist()], np.int64)
    share = kinds / np.array(cap, float)
    while left.any():
        live = left > 0
        if 2 * np.count_nonzero(live) < len(live):
            kinds, left, share = kinds[live], left[live], share[live]
        room = np.array(cap, np.int64)
        bin_: list[tuple] = []
        while True:
            # kinds are sorted by tokens, so that those with too many are a tail
            top = int(np.searchsorted(kinds[:, 0], room[0], side="right"))
            fits = (left[:top] > 0) & (kinds[:top, 1] <= room[1]) & (kinds[:top, 2] <= room[2])
            score = np.where(fits, share[:top] @ (room / np.array(cap, float)), -1.0)
            at = int(score.argmax()) if top else -1
            if at >= 0 and score[at] >= 0:
                left[at] -= 1
                bin_.append(shelves[tuple(kinds[at].tolist())].pop())
                room -= kinds[at]
            elif cut and room[0] > 0 and room[2] > 0:
                # the shortest piece that is too long gives its head
                longer = np.flatnonzero((left > 0) & (kinds[:, 0] > room[0]) & (kinds[:, 2] == 1) & (-(-kinds[:, 1] * room[0] // kinds[:, 0]) <= room[1]))
                if len(longer):
                    k = int(longer[-1])
                    key, start, n, loss, _ = shelves[tuple(kinds[k].tolist())].pop()
                    left[k] -= 1
                    head = int(room[0])
                    part = -(-loss * head // n)
                    bin_.append((key, start, head, part, 1))
                    rest = (n - head, loss - part, 1)
                    shelves[rest].append((key, start + head, *rest))
                    row = np.flatnonzero((kinds == rest).all(axis=1))
                    if len(row):
                        left[row[0]] += 1
                    else:
                        place = int(np.searchsorted(kinds[:, 0], rest[0]))
                        kinds, left = np.insert(kinds, place, rest, axis=0), np.insert(left, place, 1)
                        share = kinds / np.array(cap, float)
                break
            else:
                break
        done += split_powers(bin_) if cut and sum(p[2] for p in bin_) < limits.tokens else [bin_]
    return done


def split_powers(bin_: list[tuple]) -> list[list[tuple]]:
    """The pieces again, in sequences whose lengths are the powers of two in the total; left whole where a piece can't be cut."""
    total = sum(p[2] for p in bin_)
    if any(p[4] != 1 for p in bin_) or total.bit_count() <= 1:
        return [bin_]
    out: list[list[tuple]] = []
    todo = bin_[::-1]
    for power in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        now: list[tuple] = []
        room = power
        while room:
            key, start, n, loss, _ = todo.pop()
            head = min(room, n)
            part = -(-loss * head // n)
            now.append((key, start, head, part, 1))
            if head < n:
                todo.append((key, start + head, n - head, loss - part, 1))
            room -= head
        out.append(now)
    return out


def oversized(n: int, loss: int, segments: int, limits: Limits, cut: bool) -> bool:
    """Whether no sequence can hold an example; with cut, one of a single segment is divided where its loss tokens allow it."""
    if cut and segments == 1 and loss <= n and n >= limits.tokens:
        return -(-loss * limits.tokens // n) > limits.loss_tokens
    return n > limits.tokens or loss > limits.loss_tokens or segments > limits.segments


def pack_examples(examples: DataFrame, key: str, tokens: str, loss_tokens: str, segments: str, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """For instruction data that is tokenized elsewhere: (key, start, length, loss_tokens, segments, sequence_id, offset) under the
    limits. Null numbers count as 0, and segments as 1 at least; an example without tokens gives no row."""
    has_columns(examples, key, tokens, loss_tokens, segments)
    rows = examples.select(key, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"_{i}") for i, c in enumerate((tokens, loss_tokens, segments))])
    schema = rows.select(key, *[F.lit(None).cast("long").alias(c) for c in ("start", "length", "loss_tokens", "segments", "sequence_id", "offset")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        kind = pa.null()

        def made(held: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            fit = [p for p in held if not oversized(p[2], p[3], p[4], limits, cut)]
            out = [(*p, None, None) for p in held if oversized(p[2], p[3], p[4], limits, cut)]
            for sequence in pack(fit, limits, cut):
                at = 0
                for p in sequence:
                    out.append((*p, number, at))
                    at += p[2]
                number += 1
            cols = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=schema.names)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            kind = batch.schema.types[0]
            k, n, loss, seg = (batch.column(i).to_pylist() for i in range(4))
            held += [(a, 0, b, c, max(1, d)) for a, b, c, d in zip(k, n, loss, seg, strict=True)]
            size += sum(n)
            if size > GROUP_TOKENS:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, limits: Limits = Limits(), ids: bool = True) -> DataFrame:
    """Pieces of tokenized texts in packed sequences.

    tokenizer: the vocabulary file, which each executor has at this path. Columns: doc_id, start, length, doc_tokens,
    sequence_id, offset, loss_tokens, segments (long) and ids_le (binary: the piece's ids, unsigned 32-bit little-endian).
    Every token of a document bears loss and a piece is one segment, so that a piece's vector grows with its length: the
    dot product then takes the longest piece that fits, until the segments run out.
    """
    has_columns(docs, doc_id, text)
    rows = widened(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "loss_tokens", "segments")], F.lit(b"").alias("ids_le")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer, end_id)
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[object, np.ndarray]] = []
        kind = pa.int64()

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []
            for sequence in pack([(i, 0, len(x), len(x), 1) for i, (_, x) in enumerate(held)], limits):
                at = 0
                for i, start, n, loss, segments in sequence:
                    d, x = held[i]
                    rows.append((d, start, n, len(x), number, at, loss, segments, x[start : start + n].astype("<u4").tobytes()))
                    at += n
                number += 1
                if len(rows) >= 4096:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:8]), pa.array(cols[8], pa.binary())], names=schema.names)

        size = 0
        for batch in batches:
            kind = batch.schema.types[0]
            for part in slices(batch, 1, SLICE_BYTES):
                flat, sizes = encode(part.column(1))
                cuts = np.cumsum(sizes)
                held += [(d, flat[c - n : c]) for d, n, c in zip(part.column(0).to_pylist(), sizes.tolist(), cuts.tolist(), strict=True)]
                size += len(flat)
                if size > GROUP_TOKENS:
                    yield from made()
                    held, size = [], 0
        if held:
            yield from made()
        held = []
        release_memory()

    return rows.mapInArrow(run, schema)
