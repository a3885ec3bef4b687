import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import sharding


def check(rows, source, shards):
    assert len(rows) == len(source)
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((str(x["doc_id"]), len((x["text"] or "").encode()) + 16, zlib.crc32((x["text"] or "").encode())) for x in source)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want


def cut(rows):
    by = {}
    for r in rows:
        by.setdefault(r["group"], set()).add(r["shard"])
    return sum(len(v) > 1 for v in by.values())


def test_documents(docs, empty):
    check(sharding.shard_documents(docs, 7).collect(), docs.collect(), 7)
    check(sharding.shard_documents(docs, 500).collect(), docs.collect(), 500)
    assert sharding.shard_documents(empty).count() == 0


def test_groups_stay_together_and_a_hot_one_is_split(spark):
    rows = [(i, f"copy {i % 150}") for i in range(900)] + [(1000 + i, "hot") for i in range(500)] + [(2000 + i, f"single {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, 10).collect()
    check(got, df.collect(), 10)
    assert cut(got) <= 10
    hot = Counter(r["shard"] for r in got if 1000 <= r["doc_id"] < 2000)
    assert len(hot) >= 3
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_documents(df, 10).collect()))


def test_groups_that_fit_a_shard_stay_whole(spark):
    rows = [(i, f"copy {i % 4}") for i in range(480)] + [(1000 + i, f"single {i}") for i in range(520)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert cut(got) == 0 and sorted(Counter(r["shard"] for r in got).values()) == [250] * 4
    # sizes of a fifth to a whole shard, with little room left
    sizes = [100, 100, 90, 80, 70, 60, 50, 40, 30, 20, 20, 20]
    rows = [(100 * g + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)] + [(5000 + i, f"single {i}") for i in range(120)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(got, [dict(doc_id=d, text=t) for d, t in rows], 8)
    assert cut(got) <= 1


def test_large_moves_against_capacity():
    import random

    dice = random.Random(3)
    for _ in range(200):
        shards, room = dice.randint(2, 6), 20
        parts = [[dice.randint(0, 5) for _ in range(shards)] for _ in range(dice.randint(1, 8))]
        load = [sum(p[s] for p in parts) + 3 for s in range(shards)]
        after = load[:]
        moves = sharding._large_moves([dict(part=i, shard=s, n=n) for i, p in enumerate(parts) for s, n in enumerate(p) if n], after, room)
        want = load[:]
        for part, goal in moves.items():
            want = [x - n for x, n in zip(want, parts[part], strict=True)]
            want[goal] += sum(parts[part])
        assert after == want
        # the parts that are whole afterwards fit their shards
        whole = [0] * shards
        for i, p in enumerate(parts):
            if i in moves:
                whole[moves[i]] += sum(p)
        assert max(whole) <= room


def test_propagation_goes_to_the_plurality(spark):
    """With room for all, every part ends where most of it was; ties go to the least shard."""
    import random

    dice = random.Random(7)
    rows = [(p, dice.randrange(5)) for p in range(60) for _ in range(dice.randint(2, 30))]
    got = {(r["part"], r["shard"]) for r in sharding.propagate(spark.createDataFrame(rows, "part long, shard int"), 5, 10**6).collect()}
    want = set()
    for p in range(60):
        counts = Counter(s for q, s in rows if q == p)
        want.add((p, min(counts, key=lambda s: (-counts[s], s))))
    assert got == want


def test_cut_links_against_pairs(spark):
    rows = [("a", 0), ("a", 0), ("a", 1), ("b", 2), ("b", 2), ("c", 1), ("d", 0), ("d", 1), ("d", 2), ("d", 2), ("d", 0)]
    found = sharding.cut_links(spark.createDataFrame(rows, "group string, shard int"), 3).first()
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0]]
    # a share is four rows, so that of d's five one at least lies apart from four
    assert tuple(found) == (3, 2, len(pairs), sum(x[1] != y[1] for x, y in pairs), 4)


def plain_placement(moved, rest, total, shards):
    """The rule in row loops: whole parts by falling size while they fit their shard's share; all others fill what is left, in order."""
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    parts = {}
    for p, s, *_ in moved:
        parts.setdefault(p, []).append(s)
    stay = set()
    for s in range(shards):
        own = sorted((-len(x), p) for p, x in parts.items() if set(x) == {s})
        before = 0
        for size in sorted({-n for n, _ in own}, reverse=True):
            alike = [p for n, p in own if -n == size]
            room = max(0, (goal[s] - before) // size)
            stay.update(alike[:room])
            before += size * len(alike)
    out, slot = [], [0] * shards
    for p, s, d, n in sorted((r for r in moved if r[0] in stay), key=lambda r: (r[0], r[2], r[3])):
        out.append((p, d, s, slot[s]))
        slot[s] += 1
    left = sorted([(r[0], r[2], r[3]) for r in moved if r[0] not in stay] + list(rest))
    s = 0
    for p, d, _ in left:
        while slot[s] >= goal[s]:
            s += 1
        out.append((p, d, s, slot[s]))
        slot[s] += 1
    return sorted(out)


def test_placement_against_row_loops(spark):
    import random

    for seed in range(4):
        dice = random.Random(seed)
        moved, d = [], 0
        for p in range(40):
            home = dice.randrange(5)
            for _ in range(dice.choice([2, 2, 3, 5, 30])):
                moved.append((p * 7 - 50, home if dice.random() < 0.9 or p % 2 else dice.randrange(5), d, dice.randint(16, 99)))
                d += 1
        rest = [(1000 + i, d + i, 20) for i in range(30)]
        total = len(moved) + len(rest)
        got = sharding.placement(spark.createDataFrame(moved, "part long, shard int, doc_id long, size long"), spark.createDataFrame(rest, "part long, doc_id long, size long"), total, 5)
        assert sorted((r["part"], r["doc_id"], r["shard"], r["slot"]) for r in got.collect()) == plain_placement(moved, rest, total, 5)


def test_a_part_as_large_as_a_shard_is_in_many_tasks(spark):
    """Two groups of 20,000 rows fill a shard each; what is sorted in a task is a range of rows, not a part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        rows = spark.range(20_000).select(F.lit(1).alias("part"), F.col("id").alias("doc_id"))
        dealt = rows.repartitionByRange("part", "doc_id").groupBy(F.spark_partition_id().alias("p")).count()
        assert dealt.agg(F.max("count")).first()[0] < 4000
        df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise("other").alias("text"))
        placed = sharding.shard_documents(df, 2)
        assert sorted(tuple(r) for r in placed.groupBy("shard").agg(F.countDistinct("group"), F.count("*"), F.max("slot")).collect()) == [(0, 1, 20_000, 19_999), (1, 1, 20_000, 19_999)]
        assert "Window" not in sharding.positions(rows, ["part", "doc_id"], name="at")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
