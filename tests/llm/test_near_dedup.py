import random

import numpy as np
import pytest

from tessera.llm import near_dedup


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """For each row the least id of its component."""
    sets = sorted({shingle_set(t) for _, t in rows}, key=sorted)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    comp = {s: find(i) for i, s in enumerate(sets)}
    least = {}
    for d, t in rows:
        least[comp[shingle_set(t)]] = min(least.get(comp[shingle_set(t)], d), d)
    return {(d, least[comp[shingle_set(t)]]) for d, t in rows}


def near_copies(seed=9):
    """Texts, each with copies in which from 1 to 20 words are changed: similarities on both sides of 0.8."""
    dice = random.Random(seed)
    out = []
    for _ in range(40):
        words = [f"w{dice.randrange(5000)}" for _ in range(300)]
        out.append(" ".join(words))
        for changed in (1, 3, 5, 6, 7, 9, 12, 20):
            own = words[:]
            for i in dice.sample(range(300), changed):
                own[i] = f"x{dice.randrange(10**6)}"
            out.append(" ".join(own))
    dice.shuffle(out)
    return list(enumerate([*out, out[3], out[3].upper(), "", None, "one two"]))


@pytest.mark.parametrize("group", [near_dedup.GROUP, 600])
def test_links_are_those_of_jaccard(spark, group):
    rows = near_copies()
    sims = [jaccard(shingle_set(a), shingle_set(b)) for i, (_, a) in enumerate(rows) for _, b in rows[:i]]
    assert sum(0.8 <= s < 0.9 for s in sims) > 50 and sum(0.7 <= s < 0.8 for s in sims) > 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_components(df, group=group).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == brute(rows) and len(got) == len(rows)


def test_the_stage_keeps_one_of_each_component(spark, empty):
    import corpus_pipeline as P

    rows = near_copies(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in P.near_dedup_stage(spark, df, "").collect())
    assert got == sorted({least for _, least in brute(rows)})
    assert near_dedup.near_dedup(empty).count() == 0


def test_repeated_ids_with_unlike_texts(spark):
    dice = random.Random(3)
    a, b, c, d = (" ".join(f"w{dice.randrange(900)}" for _ in range(80)) for _ in range(4))
    rows = [(5, a, 1), (5, b, 1), (3, a, 1), (7, c, 1), (None, c, 1), (None, d, 1), (9, d.upper(), 2), (9, d.upper(), 1), (11, None, 0), (10, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rows int")
    out = near_dedup.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted([(3, a, 1), (5, b, 1), (7, c, 1), (9, d.upper(), 1), (10, "", 0)])


def test_documents(docs):
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()}, key=str)
    got = near_dedup.near_dedup(docs.where("doc_id is not null")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted({least for _, least in brute(rows)})


def changed(dice, words, kind, share):
    """words with about that share of them changed one by one, replaced in one place, or added in one place."""
    new = lambda k: [f"x{dice.randrange(10**6)}" for _ in range(k)]
    k, at = max(1, round(len(words) * share)), dice.randrange(len(words))
    if kind == "words":
        own = words[:]
        for i in dice.sample(range(len(words)), k):
            own[i] = new(1)[0]
        return own
    at = min(at, len(words) - k)
    return words[:at] + new(k) + words[at + (k if kind == "replaced" else 0) :]


@pytest.mark.parametrize("n", [60, 300, 1500])
@pytest.mark.parametrize("kind", ["words", "added", "replaced"])
def test_recall_by_similarity(kind, n):
    """The share of pairs of changed copies that a fingerprint brings together, in each band of similarity: 0.9 or more."""
    from tessera.llm.simhash import masks

    dice, table = random.Random(len(kind) * n), np.array([m % (1 << 64) for m in masks(near_dedup.RADIUS)], np.uint64)
    most = {"words": 0.045, "added": 0.28, "replaced": 0.13}[kind]
    met = {0.80: [], 0.85: [], 0.90: [], 0.95: []}
    for _ in range(4000):
        if min(map(len, met.values())) >= 60:
            break
        words = [f"w{dice.randrange(5000)}" for _ in range(n)]
        texts = [" ".join(words), " ".join(changed(dice, words, kind, dice.uniform(0.002, most)))]
        similar = jaccard(*map(shingle_set, texts))
        low = next((b for b in met if b <= similar < b + 0.05), None)
        if low and len(met[low]) < 150:
            x, y = near_dedup.prints_of([near_dedup.shingle_hashes(t.encode(), near_dedup.PRINT_WORDS) for t in texts])
            met[low].append(bool(((((x ^ y)[:, None] & table) == 0).any(axis=1) & (np.bitwise_count(x ^ y) <= near_dedup.REACH)).any()))
    found = {low: sum(m) / len(m) for low, m in met.items() if len(m) >= 20}
    print(kind, n, {k: (round(v, 3), len(met[k])) for k, v in found.items()})
    assert len(found) >= 3 and min(found.values()) >= 0.9


def test_forest_against_all_pairs():
    dice = np.random.default_rng(2)
    base = dice.integers(0, 1 << 62, 200, np.uint64)
    sets = [np.unique(np.concatenate((dice.choice(base, 170 + i % 30, replace=False), dice.integers(0, 1 << 62, i % 25, np.uint64)))) for i in range(120)]
    root = list(range(len(sets)))

    def joined(pairs):
        name = list(range(len(sets)))
        for a, b in pairs:
            name = [name[a] if x == name[b] else x for x in name]
        return {frozenset(i for i, x in enumerate(name) if x == y) for y in set(name)}

    near = [(i, j) for i in root for j in root[:i] if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    assert joined(near_dedup.forest(sets, 0.8)) == joined(near)
