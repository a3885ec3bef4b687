import random

import numpy as np
import pytest

from tessera.llm import packing


def check_sequences(rows, tokens):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= tokens
        padding += 0 if at.bit_count() == 1 else tokens - at
    return padding


def test_documents(docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check_sequences(rows, 4096) == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {d for d in texts if d is not None}
    for d, parts in by.items():
        want = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        at, ids = 0, []
        for r in sorted(parts, key=lambda r: r["start"]):
            piece = np.frombuffer(r["ids_le"], "<u4")
            assert r["start"] == at and r["length"] == len(piece) and r["doc_tokens"] == len(want)
            ids += piece.tolist()
            at += len(piece)
        assert ids == want


def test_odd_texts_tokenize_as_wholes():
    P = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = ["A  b\n\nc", "", " lead", "trail \t", "it's  you'RE 12 345", "é é  x y İ ΑΣ", "x" * 3000, "<|endoftext|> hi", "日本語 テスト​", "a\u0085b"]
    ids, sizes = packing.WordTokenizer(path, 2)(pa.array([*texts, None]))
    tok = Tokenizer.from_file(path)
    at = 0
    for t, n in zip([*texts, ""], sizes, strict=True):
        assert ids[at : at + n].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2]
        at += n


@pytest.mark.parametrize("cut", [True, False])
def test_limits_hold(cut):
    dice = random.Random(2)
    limits = packing.Limits(100, 6, 60)
    pieces = []
    for i in range(500):
        n = dice.randint(1, 100)
        pieces.append((i, 0, n, dice.randint(0, min(n, 60)), dice.randint(1, 3)))
    out = packing.pack(pieces, limits, cut)
    total = {}
    for seq in out:
        assert sum(p[2] for p in seq) <= 100 and sum(p[3] for p in seq) <= 60 and sum(p[4] for p in seq) <= 6
        for key, start, n, loss, _ in seq:
            total.setdefault(key, []).append((start, n, loss))
    for i, _, n, loss, _ in pieces:
        at = 0
        for start, m, _ in sorted(total[i]):
            assert start == at
            at += m
        assert at == n and sum(x[2] for x in total[i]) == loss
    if not cut:
        need = max(sum(p[2] for p in pieces) / 100, sum(p[3] for p in pieces) / 60, sum(p[4] for p in pieces) / 6)
        assert len(out) < 1.15 * need


def test_examples(spark):
    df = spark.createDataFrame([(i, 10 + i % 50, i % 7, 1 + i % 3) for i in range(300)] + [(1000, None, None, None)], "ex long, tokens int, loss int, segs int")
    rows = packing.pack_examples(df, "ex", "tokens", "loss", "segs", packing.Limits(128, 8, 40)).collect()
    assert sum(r["length"] for r in rows) == sum(10 + i % 50 for i in range(300))
    by = {}
    for r in rows:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert max(by.values()) <= 128


def test_oversized_examples(spark):
    rows = [("ok", 100, 10, 2, "x"), ("long", 129, 1, 1, "x"), ("loss", 50, 41, 1, "x"), ("many", 50, 1, 9, "x"), ("none", 0, 0, 0, "x"), (None, 28, 3, 1, "x")]
    df = spark.createDataFrame(rows, "ex string, tokens int, loss int, segs int, sequence_id string")
    for cut in (False, True):
        got = {}
        for r in packing.pack_examples(df, "ex", "tokens", "loss", "segs", packing.Limits(128, 8, 40), cut).collect():
            got.setdefault(r["ex"], []).append((r["start"], r["length"], r["loss_tokens"], r["segments"], r["sequence_id"] is None, r["offset"] is None))
        assert got["loss"] == [(0, 50, 41, 1, True, True)] and got["many"] == [(0, 50, 1, 9, True, True)] and "none" not in got
        assert sum(x[1] for x in got["ok"]) == 100 and not any(x[4] for x in got["ok"] + got[None])
        assert got["long"] == [(0, 129, 1, 1, True, True)] if not cut else sum(x[1] for x in got["long"]) == 129 and not any(x[4] for x in got["long"])


def test_choice_is_that_of_the_dot_product():
    """Each choice, replayed against all pieces that are left, without cutting."""
    dice = random.Random(5)
    for _ in range(30):
        limits = packing.Limits(64, 5, 30)
        left = {i: (i, 0, dice.randint(1, 64), dice.randint(0, 30), dice.randint(1, 5)) for i in range(40)}
        cap = (limits.tokens, limits.loss_tokens, limits.segments)
        for seq in packing.pack(list(left.values()), limits, cut=False):
            room = list(cap)
            fits = lambda: [p for p in left.values() if all(x <= r for x, r in zip(p[2:], room, strict=True))]  # noqa: B023, E731
            dot = lambda p: sum(x / c * (r / c) for x, c, r in zip(p[2:], cap, room, strict=True))  # noqa: B023, E731
            for p in seq:
                assert p in fits() and dot(p) >= max(map(dot, fits())) - 1e-9
                del left[p[0]]
                room = [r - x for r, x in zip(room, p[2:], strict=True)]
            assert not fits()
        assert not left


def test_segments_bind():
    out = packing.pack([(i, 0, 1 + i % 3, 1 + i % 3, 1) for i in range(1000)], packing.Limits(4096, 64, 4096))
    assert max(sum(p[4] for p in seq) for seq in out) == 64 and all(sum(p[2] for p in seq).bit_count() == 1 for seq in out)


def test_a_tokenizer_of_another_kind_is_refused():
    P = pytest.importorskip("public_tokenizers")
    import glob
    import os

    refused = 0
    for path in glob.glob(os.path.join(os.path.dirname(P.path("word_bpe_49k.json")), "*.json")):
        from tokenizers import Tokenizer

        try:
            tok = Tokenizer.from_file(path)
        except Exception:  # noqa: BLE001 not a tokenizer file
            continue
        low = tok.encode("Two Words", add_special_tokens=False).ids == tok.encode("two words", add_special_tokens=False).ids
        if not low:
            with pytest.raises(ValueError, match="whole text"):
                packing.WordTokenizer(path, 2)
            refused += 1
    assert refused


def test_empty(empty):
    P = pytest.importorskip("public_tokenizers")
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json")).count() == 0
