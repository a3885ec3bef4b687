import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import quality_fm as fm
from tests.llm.conftest import DOCS

SMALL = {"words": 1 << 10, "factors": 4, "epochs": 8}


def sample(dice, n, features, factors=3):
    w, v = dice.normal(size=features), dice.normal(size=(features, factors))
    own = [np.sort(dice.choice(features, dice.integers(0, 6), replace=False)) for _ in range(n)]
    doc = np.repeat(np.arange(n), [len(o) for o in own])
    return w, v, doc, np.concatenate(own).astype(int), dice.normal(size=len(doc))


def pairs_score(w, v, doc, feature, value, n):
    """The definition: each pair of a text's features."""
    out = np.zeros(n)
    for i in range(n):
        at = np.flatnonzero(doc == i)
        out[i] = sum(w[feature[a]] * value[a] for a in at)
        out[i] += sum(v[feature[a]] @ v[feature[b]] * value[a] * value[b] for k, a in enumerate(at) for b in at[:k])
    return out


def test_score_equals_all_pairs():
    case = sample(np.random.default_rng(1), 40, 12)
    assert np.allclose(fm.raw_score(*case, 40)[0], pairs_score(*case, 40))


def test_training_follows_the_gradient():
    """One step of Adam from zero moments goes by the sign of each gradient, found here by differences."""
    dice = np.random.default_rng(2)
    sizes = np.full(6, 4)
    n = fm.buckets(4)
    bucket, value, y = dice.integers(0, 4, 24), dice.uniform(0.5, 1, 24), np.array([1.0, 0, 1, 0, 0, 1])
    got = fm.train(y, sizes, bucket, value, words=4, factors=2, epochs=1, batch=6, rate=1e-3, decay=0.0)
    start = np.random.default_rng(7).normal(0, 0.05, (n, 2))
    doc = np.repeat(np.arange(6), 4)

    def loss(w, v):
        p = fm.sigmoid(fm.raw_score(w, v, doc, bucket, value, 6)[0])
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    for i in range(4):
        for part in range(3):
            w, v = np.zeros((2, n)), np.stack((start, start))
            for side, h in enumerate((-1e-5, 1e-5)):
                if part == 2:
                    w[side, i] += h
                else:
                    v[side, i, part] += h
            slope = (loss(w[1], v[1]) - loss(w[0], v[0])) / 2e-5
            moved = got.w[i] if part == 2 else got.v[i, part] - start[i, part]
            if abs(slope) > 1e-6:
                assert np.sign(moved) == -np.sign(slope)


def test_features_equal_plain_ones(spark, docs):
    n_chars = ("n_chars",)
    got = fm._inputs(docs, [], "text", n_chars).toArrow().combine_chunks().to_batches()[0]
    doc, bucket, value = fm._features(got, 1 << 15, 1)
    for i, r in enumerate(docs.collect()):
        text = r["text"] or ""
        words = text.split()
        at = doc == i
        seen = {}
        for w in words:
            b = xxhash.xxh64_intdigest(w.lower()) % (1 << 15)
            seen[b] = seen.get(b, 0) + 1
        mine = dict(zip(bucket[at].tolist(), value[at].tolist(), strict=True))
        assert {b: round(x, 9) for b, x in mine.items() if b < 1 << 15} == {b: round((c / len(words)) ** 0.5, 9) for b, c in seen.items()}
        letters = sum(c.isalpha() for c in text)
        chars = sum(map(len, words))
        w, c = max(len(words), 1), max(chars, 1)
        plain = [
            len(words), chars / w, letters / c, sum(x.isupper() for x in text) / max(letters, 1), sum(x.isdigit() for x in text) / c, sum(x in "#*$%&<>@^~=_\\{}[]" for x in text) / w,
            text.count("|") / w, text.count("!") / w, (text.count(".") + text.count("?")) / w, len(words) / (text.count("\n") + 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, len(seen) / w**0.5,
        ]
        ranges = {(1 << 15) + j * fm._WIDTH + sum(x >= b for b in bounds) for j, ((_, bounds), x) in enumerate(zip(fm.STATISTICS, plain, strict=True))}
        assert {b for b in mine if 1 << 15 <= b < fm.buckets(1 << 15)} == ranges
        assert {b for b in mine if b >= fm.buckets(1 << 15)} == ({fm.buckets(1 << 15) + (r["n_chars"] + 1).bit_length() - 1} if r["n_chars"] is not None else set())


def labelled(n=400, seed=3):
    dice = random.Random(seed)
    words = ["".join(dice.choices("abcdefghij", k=dice.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        good = dice.random() < 0.7
        body = [dice.choice(words) for _ in range(dice.randint(5, 200))]
        if not good:
            body = [w + dice.choice(["###", "$$", "%"]) for w in body] if dice.random() < 0.5 else [w + " |" for w in body]
        text = " ".join(body) + ("." if good else "")
        rows.append((i, text, "en", "s", len(text), 7, "x"))
        if dice.random() < 0.8:
            labels.append((i, int(good), 0))
    return rows, labels


def scores(found):
    return {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in found.collect()}


def test_held_out_rows_are_told_apart_and_their_labels_not_used(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = scores(fm.score_held_out(docs, told, **SMALL))
    assert {i: h for i, (h, _, _) in got.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in got} and len(got) == len(rows)
    own = [(q, got[i]) for i, q, _ in labels if got[i][0]]
    assert sum(q == p for q, (_, _, p) in own) >= 0.97 * len(own)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got.values())
    wrong = spark.createDataFrame([(i, 1 - q if got[i][0] else q, 1) for i, q, _ in labels], told.schema)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert scores(fm.score_held_out(other.repartition(1), wrong, **SMALL)) == got


def test_the_sample_is_bounded_and_repeated_ids_count_once(spark):
    rows, labels = labelled(60)
    rows += [rows[2]] * 300 + [(2, "aaa another text", "en", "s", None, 0, "")]
    labels += [(2, 0, 0), (2, 1, 0), (3, None, 0), (4, 7, 0), (None, 1, 0)]
    docs, told = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    keep = fm.train
    fm.train = lambda y, sizes, *a: seen.append(len(y)) or keep(y, sizes, *a)
    try:
        fm.fit(docs, told, sample=20, **SMALL)
        fm.fit(docs, told, **SMALL)
        fm.fit(docs, told, text_bytes=40, **SMALL)
    finally:
        fm.train = keep
    assert seen[0] <= 20 and seen[2] < seen[1] <= len({x[:2] for x in labels})


def test_odd_rows_and_no_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = fm.score_held_out(docs, none, **SMALL).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(50)], none.schema)
    assert {round(r["score"], 4) for r in fm.score_held_out(docs, ones, **SMALL).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(120)], none.schema)
    got = fm.score_held_out(docs, both, **SMALL).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert fm.score_held_out(empty, both, **SMALL).count() == 0
    with pytest.raises(ValueError):
        fm.score_held_out(docs.drop("text"), both)


def test_clashing_columns_and_long_texts(spark):
    model = fm.train(np.array([0.0, 1.0]), np.array([1, 1]), np.array([0, 1]), np.array([1.0, 1.0]), words=16, factors=2, epochs=1)
    docs = spark.createDataFrame([(1, "a b " * 500_000, 3, 4, 5, 6), (2, None, 3, 4, 5, 6)], "doc_id long, text string, in0 int, row int, _ int, SCORE int")
    out = fm.score(docs, model)
    assert out.columns == ["doc_id", "in0", "row", "_", "score", "predicted"]
    assert [tuple(r)[:4] for r in out.orderBy("doc_id").collect()] == [(1, 3, 4, 5), (2, 3, 4, 5)]
