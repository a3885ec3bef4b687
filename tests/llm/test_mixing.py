import random
import re
import struct

import pytest
import xxhash

from tessera.llm import mixing


def brute_targets(sizes, weights, cap):
    left, free, out = float(sum(sizes.values())), dict(sizes), {}
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    while True:
        total = sum(w[s] for s in free)
        full = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in free}
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        for s in full:
            del free[s]


def test_mix(docs):
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.CAP)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["src"]] and abs(r["target"] - want[r["src"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["src"]] = taken.get(r["src"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(0.02 * want[s], 3), (s, t, want[s])
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs).collect()))


def test_tilt_is_the_balance(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (i + 1)), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(3, 1)).collect()
    for s in "ab":
        own = [r for r in got if r["src"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 5


def test_mixed_repeats_rows(docs, empty):
    want = sum(r["copies"] for r in mixing.mix(docs).collect())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == want
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 300}
    totals = spark.createDataFrame(list(sizes.items()), "src string, size long")
    want = brute_targets(sizes, (5, 2, 1), 3)
    for r in mixing.source_targets(totals).collect():
        assert abs(r["target"] - want[r["src"]]) < 1e-6


def spark_hash(*longs):
    """F.xxhash64 of longs, signed."""
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_copies(own, rate, cap, bucket):
    """Copies by id: buckets of a source's rows, each from the longest down, with what is owed carried on."""
    out, buckets, n = {}, {}, -(-len(own) // bucket)
    for r in own:
        buckets.setdefault(spark_hash(r["doc_id"], r["size"]) % n, []).append(r)
    for rows in buckets.values():
        owed = 0.0
        for r in sorted(rows, key=lambda r: (-r["size"], spark_hash(r["doc_id"]), r["doc_id"])):
            owed += rate(r["size"]) * r["size"]
            out[r["doc_id"]] = min(range(cap + 1), key=lambda c: (abs(owed - c * r["size"]), -c)) if r["size"] else 0
            owed -= out[r["doc_id"]] * r["size"]
    return out


@pytest.mark.parametrize("bucket", [mixing.BUCKET, 60])
def test_rates_and_copies_against_brute(spark, bucket, monkeypatch):
    """The dual by bisection, one source at a time, and the copies of each document by a row loop."""
    from math import exp

    monkeypatch.setattr(mixing, "BUCKET", bucket)

    dice = random.Random(6)
    rows = [(i, " ".join(["w"] * dice.choice([0, 1, 2, 5, 9, 30, 200])), dice.choice("aabbbbc")) for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4, 1)).collect()
    for one in "abc":
        own = [r for r in got if r["src"] == one]
        size, target = own[0]["source_size"], own[0]["target"]
        mean = size / len(own)
        rate = lambda tilt, n: min(3.0, exp(min(tilt * n / mean, 50)))  # noqa: B023, E731
        lo, hi = -200.0, 200.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(rate(mid, r["size"]) * r["size"] for r in own) < target else (lo, mid)
        full = target >= 3 * size * (1 - 1e-9)
        assert {r["doc_id"]: r["copies"] for r in own} == brute_copies(own, lambda n: 3.0 if full else rate(lo, n), 3, bucket)  # noqa: B023
        if bucket < len(own):
            continue
        carry = sum((3.0 if full else rate(lo, r["size"])) * r["size"] for r in own) - sum(r["taken"] for r in own)
        assert abs(carry) <= max(r["size"] for r in own) / 2 + 1
        # within a size, copies are whole numbers around the rate, and their mean follows it
        for n in {r["size"] for r in own} - {0}:
            copies = [r["copies"] for r in own if r["size"] == n]
            want = 3.0 if full else rate(lo, n)
            assert abs(sum(copies) / len(copies) - want) <= 1.5 / len(copies) + 200 / 2 / n / len(copies), (one, n, want)
            assert max(copies) <= 3


def test_no_silent_stop(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (i + 1)), "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    hist = df.selectExpr("source as hsrc", "doc_id + 1 as len", "1 as docs")
    totals = hist.groupBy("hsrc").agg({"len": "sum", "docs": "count"}).selectExpr("hsrc as src", "`sum(len)` as size", "`count(docs)` as n", "0.3d * `sum(len)` as target")
    with pytest.raises(ValueError, match="converge"):
        mixing.tilts(hist, totals, steps=1)
