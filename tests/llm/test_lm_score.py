import re
from collections import Counter
from math import log

import pytest

from tessera.llm import lm_score


def brute(texts, order, alpha, least):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + k]) for w in words for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        micro = 0
        for i in range(len(w)):
            s = log(counts[(w[i],)] / total)
            for k in range(2, min(order, i + 1) + 1):
                g = tuple(w[i - k + 1 : i + 1])
                s = log(counts[g] / counts[g[:-1]]) if counts[g] >= least else log(alpha) + s
            micro += round(s * 1e6)
        out.append((len(w), micro / 1e6))
    return out


key = lambda r: (str(r[0]), r[1], round(r[2], 3))


@pytest.mark.parametrize(("order", "options"), [(3, {}), (2, {"block": 500, "passes": 3, "frequent": 20}), (3, {"block": 700, "passes": 2, "frequent": 50}), (1, {"passes": 1, "frequent": 1}), (2, {"min_count": 1}), (4, {"min_count": 3, "frequent": 5})])
def test_against_brute(docs, order, options):
    rows = docs.collect()
    want = brute([r["text"] for r in rows], order, 0.4, options.get("min_count", 2))
    got = lm_score.lm_scores(docs, order=order, **options).collect()
    assert sorted(map(key, ((r["doc_id"], n, s) for r, (n, s) in zip(rows, want, strict=True)))) == sorted(map(key, (tuple(r) for r in got)))


def test_hash_is_that_of_the_joins(spark):
    import numpy as np

    dice = np.random.default_rng(2)
    a, b = (dice.integers(0, 1 << 64, 50, np.uint64) for _ in range(2))
    df = spark.createDataFrame(list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)), "a long, b long")
    assert [r[0] for r in df.selectExpr("xxhash64(a, b)").collect()] == lm_score.join_halves(a, b).view(np.int64).tolist()


def test_counts_beyond_32_bits(spark):
    big = 7 << 33
    table = spark.createDataFrame([(1, 11, 0, 2 * big), (1, 12, 0, big), (2, 11, 12, big // 2)], "k byte, prefix long, suffix long, n long")
    pair = spark.sql("select xxhash64(11L, 12L)").first()[0]
    got = {r["gram"]: r for r in lm_score.weights(table, 2, 3 * big).collect()}
    assert got[11]["w0"] == round(1e6 * log(2 / 3)) and got[12]["w1"] == round(1e6 * (log(0.4) + log(1 / 3))) and got[12]["n"] == big
    assert got[pair]["w0"] == round(1e6 * log(1 / 4)) - got[12]["w1"] and got[pair]["w1"] is None


def test_tables_of_the_orders_go(docs, monkeypatch):
    gone = []
    monkeypatch.setattr(lm_score, "discard", lambda written: gone.extend(f.rsplit("/", 1)[0] for f in written.inputFiles()))
    counts = lm_score.count_tables(lm_score.text_blocks(docs, "doc_id", "text"), 3)
    kept = {f.rsplit("/", 1)[0] for f in lm_score.weights(counts, 3, 1000).inputFiles() + counts.inputFiles()}
    assert len(set(gone)) == 3 and not kept & set(gone)


def test_only_grams_of_frequent_halves_are_dealt_out(monkeypatch):
    """An n-gram occurs no more often than its halves, so that one with a rare half needs no count."""
    import numpy as np
    import pyarrow as pa

    words = "a b a b c d e".split()
    vocab, codes = np.unique(words, return_inverse=True)
    known = pa.table({"block": [5], "ids": [[1, 2]], "sizes": [lm_score._planes(np.array([7, 0]))], "vocab": [np.arange(1, len(vocab) + 1, dtype="<u8").tobytes()], "codes": [lm_score._planes(codes)], "counts": pa.array([[]], pa.list_(pa.binary())), "opened": [b""]})
    dealt = []
    monkeypatch.setattr(lm_score, "PACKED", 1)
    for k in (1, 2, 3):
        rows = pa.Table.from_batches(lm_score._exploded(k, 0, 1)(known.select(["block", "sizes", "vocab", "codes", "opened"]).to_batches()))
        dealt.append(sorted(rows["n"].to_pylist()))
        back = rows.filter(pa.compute.greater_equal(rows["n"], 1 if k == 1 else 2)).select(["block", "place", "n"]).to_batches(max_chunksize=2)
        found = list(lm_score._packed(iter(back)))
        assert len(found) == {1: 3, 2: 1, 3: 0}[k]
        counted = pa.Table.from_batches(found, pa.schema([("block", pa.int64()), ("places", pa.binary()), ("totals", pa.binary())]))
        known = lm_score._with_counts(k, 3, 7, 0.4, 2)(known, counted)
    assert dealt == [[1, 1, 1, 2, 2], [1, 2], []]  # of two-word ones a b and b a
    assert [(n, s) for _, n, s in map(tuple, (r.values() for r in known.to_pylist()))] == brute([" ".join(words), ""], 3, 0.4, 2)


def test_counts_beyond_32_bits_come_back():
    import numpy as np
    import pyarrow as pa

    big = 7 << 40
    found = list(lm_score._packed(iter([pa.record_batch({"block": [1, 1], "place": [1, 0], "total": [big, 3]})])))
    got = lm_score._counts_of(1, np.zeros(0, np.uint64), 2, b"", pa.Table.from_batches(found))
    assert got.tolist() == [3, big]


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,2)", "string", "int", "binary", "date"])
def test_ids_of_any_type(spark, kind):
    value = {"date": "date'2020-01-02'", "binary": "X'0102'"}.get(kind, f"cast(7 as {kind})")
    df = spark.sql(f"select {value} as ident, 'a b a b' as body, 1 as micro union all select null, 'a', 2")
    got = lm_score.lm_scores(df, "ident", "body")
    assert dict(got.dtypes)["doc_id"] == kind
    assert sorted((r["doc_id"] is None, r["n_words"]) for r in got.collect()) == [(False, 4), (True, 1)]


def test_empty(empty, spark):
    assert lm_score.lm_scores(empty).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, lm_score.lm_scores(df).collect())) == [(1, 0, 0.0), (2, 0, 0.0)]


@pytest.mark.parametrize(("name", "order"), [("op4_lm_score", 3), ("op4_lm_score_order2", 2)])
def test_registered(spark, docs, tmp_path, name, order):
    from tessera.llm.queries import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    want = brute([r["text"] for r in rows], order, 0.4, 2)
    got = queries()[name](spark, str(tmp_path)).collect()
    assert sorted(map(key, ((r["doc_id"], n, s) for r, (n, s) in zip(rows, want, strict=True)))) == sorted(map(key, (tuple(r) for r in got)))
