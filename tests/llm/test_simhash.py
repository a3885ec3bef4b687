import itertools
import random

import numpy as np
import xxhash

from tessera.llm import simhash


def brute_print(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(b)] = find(a)
    return {f: find(f) for f in root}


def check(rows, found, size, radius):
    fps = {(r["doc_id"], r["text"]): brute_print(r["text"], size) for r in rows}
    comp = brute_components(set(fps.values()), radius)
    least = {}
    for (d, _), f in fps.items():
        if d is not None:
            least[comp[f]] = min(least.get(comp[f], d), d)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], fps[r["doc_id"], r["text"]], least.get(comp[fps[r["doc_id"], r["text"]]])) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want


def test_documents(docs):
    check(docs.collect(), simhash.simhash_components(docs).collect(), 4, 4)


def test_wide_radius_links(docs):
    check(docs.collect(), simhash.simhash_components(docs, shingle=2, radius=6).collect(), 2, 6)


def test_masks_cover():
    dice = random.Random(3)
    table = [m % (1 << 64) for m in simhash.masks(4)]
    for _ in range(3000):
        bits = sum(1 << b for b in dice.sample(range(64), 4))
        assert any(not bits & m for m in table)


def test_large_buckets_and_chains(spark):
    dice = random.Random(5)
    seeds = [dice.getrandbits(64) for _ in range(4)]
    fps = set()
    for s in seeds:
        x = s
        for _ in range(60):  # chains: each step flips three bits
            for b in dice.sample(range(64), 3):
                x ^= 1 << b
            fps.add(x)
        fps.update(s ^ sum(1 << b for b in dice.sample(range(64), 2)) for _ in range(60))
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from tessera.llm.graph import components

    for bucket in (20_000, 8):
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, "fp", 4, bucket), "a", "b").collect()}
        want = brute_components(fps, 4)
        groups = {}
        for f in fps:
            groups.setdefault(want[f], set()).add(f)
        mine = {}
        for f in signed:
            mine.setdefault(roots.get(f, f), set()).add(f % (1 << 64))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_no_bucket_table_is_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("xxhash64(id) as fp").write.parquet(f"{tmp_path}/nodes")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/nodes"), "fp", 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_existing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, FP int, _text string")
    out = simhash.fingerprints(df)
    assert out.columns == ["doc_id", "_text", "fp"] and dict(out.dtypes)["fp"] == "bigint"
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in out.collect()} == {1: brute_print("a b c", 4), 2: 0}


def test_long_texts_in_segments(monkeypatch):
    dice = random.Random(8)
    texts = [" ".join("".join(dice.choices("abC", k=dice.randint(1, 9))) + dice.choice(["", " ", "\n\t"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 40, 200)]
    texts += [" " * 50 + "a b c d e", "a" * 200, "a b" + " " * 90]
    whole = [[simhash.shingle_hashes(t.encode(), k).tolist() for k in (1, 4, 5)] for t in texts]
    for size in (1, 7, 30):
        monkeypatch.setattr(simhash, "SEGMENT", size)
        assert [[simhash.shingle_hashes(t.encode(), k).tolist() for k in (1, 4, 5)] for t in texts] == whole


def test_empty(empty):
    assert simhash.simhash_components(empty).count() == 0
