"""Sharding by balanced label propagation: linked documents move together, and shards stay even to one row.

Links join documents of equal group; a group stands for its clique, so that no pair is ever made. Only a group that
no shard can hold is cut first, into as few parts as shards it needs, of equal size. Labels start from the id's hash.
In each round a part's documents move to the shard in which most of the part is (ties: the least), as far as the quota
of that shard's free rows admits: large parts, of which there are at most LARGE a shard, one by one, the largest first,
before all others, and to the next shard with room where theirs has none; smaller ones whole by hash. Rounds end when
nothing moves.

Parts that have come together keep their shard up to its exact share of the rows, the largest first; the other parts and
the documents without links fill what is left, numbered part by part, so that only parts at a border are cut. Counts so
differ by one at most.

Defined results: null text is of size 16 and all null texts are one group; repeated rows are documents of their own;
a table with fewer rows than shards leaves the last shards empty; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_PER_BUCKET, has_columns, materialize, number
from tessera.operators.ordered import positions

ROUNDS = 6
LARGE = 16


def _counts(df: DataFrame, key: str) -> dict[int, int]:
    """Rows by shard: at most one entry a shard."""
    return {r[key]: r["n"] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}


def _large_moves(cells: list, load: list[int], room: int) -> dict:
    """{part: goal} for the large parts, which lie in cells (part, shard, n); load, the rows of each shard, follows the moves.

    Among themselves they may fill a shard, whatever smaller ones it holds by now, as those give way."""
    at: dict = {}
    for c in cells:
        at.setdefault(c["part"], {})[c["shard"]] = c["n"]
    free, out = [room] * len(load), {}
    for part, own in sorted(at.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(own.values())
        # where most of it is, then where most room is
        goals = sorted((s for s in range(len(free)) if free[s] >= size), key=lambda s: (-own.get(s, 0), -free[s], s))
        if not goals:
            continue
        free[goals[0]] -= size
        if own.get(goals[0]) != size:
            out[part] = goals[0]
            for s, n in own.items():
                load[s] -= n
            load[goals[0]] += size
    return out


def propagate(linked: DataFrame, shards: int, room: int, rounds: int = ROUNDS) -> DataFrame:
    """linked (part, shard, ...) with shard moved towards the rest of the part; room: rows that a shard may hold."""
    now = linked
    for turn in range(rounds):
        count = _counts(now, "shard")
        load = [count.get(s, 0) for s in range(shards)]
        cells = materialize(now.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n")))
        sizes = cells.groupBy("part").agg(F.sum("n").alias("all"))
        large = sizes.where(F.col("all") * LARGE >= room).select("part")  # at most LARGE a shard, as all rows fit the shards
        moves = _large_moves(cells.join(large, "part", "left_semi").collect(), load, room)
        free = [max(0, room - n) for n in load]
        has_room = F.element_at(F.array(*[F.lit(x > 0) for x in free]), F.col("shard") + 1)
        # most neighbours first, among shards with room; the least shard on ties
        best = F.max(F.struct(has_room.alias("open"), F.col("n").alias("n"), (-F.col("shard")).alias("s")))
        parts = cells.groupBy("part").agg(best.alias("b"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).where((F.col("k") > 1) & (F.col("all") * LARGE < room))
        goals = materialize(parts.select("part", (-F.col("b.s")).alias("goal"), (F.col("all") - F.col("b.n")).alias("n")))
        asked = {r["goal"]: r["n"] for r in goals.groupBy("goal").agg(F.sum("n").alias("n")).collect()}
        if not asked and not moves:
            break
        # as many whole parts as the quota takes; what leaves a shard is room for the next round
        chance = F.element_at(F.array(*[F.lit(min(1.0, free[s] / max(1, asked.get(s, 0)))) for s in range(shards)]), F.col("goal") + 1)
        admitted = goals.where(F.pmod(F.xxhash64("part", F.lit(turn)), F.lit(1 << 20)) < chance * (1 << 20)).select("part", "goal")
        if moves:
            admitted = admitted.unionAll(now.sparkSession.createDataFrame(list(moves.items()), "part long, goal int"))
        now = materialize(now.join(admitted, "part", "left").withColumn("shard", F.coalesce("goal", "shard")).drop("goal"))
    return now


def _fitting(homes: DataFrame, share: Column) -> DataFrame:
    """Of homes (part, n, home) those that fit the share of their shard when they come by falling size. Parts are summed by
    shard and size first, so that a window runs over the sizes that occur; of the size at the border as many as fit stay."""
    sizes = homes.groupBy("home", "n").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("home").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.withColumn("room", F.floor((share - F.coalesce(F.sum(F.col("n") * F.col("k")).over(before), F.lit(0))) / F.col("n"))).where("room > 0")
    near = homes.join(room, ["home", "n"])
    border = near.where(F.col("k") > F.col("room"))
    ranked = number(border, ["home"], [F.col("part")], F.pmod(F.xxhash64("part"), F.ceil(F.col("k") / F.lit(ROWS_PER_BUCKET))), "rank").where(F.col("rank") < F.col("room"))
    return near.where(F.col("k") <= F.col("room")).select("part").unionAll(ranked.select("part"))


def _place(at: Column, starts: list[int]) -> Column:
    """The last index whose start is at or below at."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in starts]), lambda s: s <= at)) - 1


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot): slot counts from 0 within the shard, without gaps."""
    has_columns(docs, doc_id, text)
    t = F.col(text)
    base = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(t.cast("binary")), F.lit("-")).alias("group"),
        )
    )
    total = base.count()
    most = max(1, total // shards)
    groups = materialize(base.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group", F.ceil(F.col("n") / F.lit(most)).alias("cuts")))
    linked = base.join(groups, "group").select(
        *base.columns,
        F.xxhash64("group", F.pmod(F.xxhash64("doc_id"), "cuts")).alias("part"),
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"),
    )
    moved = propagate(materialize(linked), shards, max(1, total // shards), rounds)
    rest = base.join(groups, "group", "left_anti").select(*base.columns, F.xxhash64("group").alias("part"))
    return placement(moved, rest, total, shards).select(*base.columns, "shard", "slot")


def placement(moved: DataFrame, rest: DataFrame, total: int, shards: int) -> DataFrame:
    """The rows of moved (part, shard, doc_id, size, ...) and rest (part, doc_id, size, ...), total in all, with their final shard
    and slot. Positions come from counts by range (operators/ordered.py), so that a part of any size lies in many tasks."""
    columns = [c for c in moved.columns if c != "shard"]
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    order = ["part", "doc_id", "size"]
    # of the parts that are whole, the largest first, those stay that end within their shard's share
    homes = moved.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("home"), F.max("shard").alias("away")).where(F.col("home") == F.col("away"))
    share = F.element_at(F.array(*[F.lit(x).cast("long") for x in goal]), F.col("home") + 1)
    whole = materialize(_fitting(homes, share).select("part"))
    settled = materialize(positions(moved.join(whole, "part", "left_semi"), order, ["shard"], "slot"))
    count = _counts(settled, "shard")
    stay = [count.get(s, 0) for s in range(shards)]
    numbered = positions(moved.join(whole, "part", "left_anti").select(*columns).unionByName(rest.select(*columns)), order, name="at")
    starts = [0, *accumulate(g - s for g, s in zip(goal, stay, strict=True))][:-1]
    shift = F.array(*[F.lit(s - a).cast("long") for s, a in zip(stay, starts, strict=True)])
    filled = numbered.withColumn("shard", _place(F.col("at"), starts).cast("int")).withColumn("slot", F.col("at") + F.element_at(shift, F.col("shard") + 1))
    return settled.select(*columns, "shard", "slot").unionByName(filled.select(*columns, "shard", "slot"))


def cut_links(placed: DataFrame, shards: int) -> DataFrame:
    """One row over shard_documents' result: groups of two rows or more, those that lie in several shards, their links (pairs of a
    group), the links cut, and the least that any placement cuts: a group larger than a shard's share fills shards one by one."""
    pairs = lambda n: n * (n - 1) / 2
    cells = placed.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(pairs(F.col("n"))).alias("kept")).where("n > 1")
    share = F.lit(max(1, -(-placed.count() // shards)))
    most = F.floor(F.col("n") / share) * pairs(share) + pairs(F.col("n") % share)
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("k") > 1).alias("in_several"), F.sum(pairs(F.col("n"))).cast("long").alias("links"),
        F.sum(pairs(F.col("n")) - F.col("kept")).cast("long").alias("cut"), F.sum(pairs(F.col("n")) - most).cast("long").alias("least"),
    )
