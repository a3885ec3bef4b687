"""Mixing sources to target weights by entropy balancing.

Targets: every source gets its weight's share of all words, at most `cap` times its own words; the excess is shared
again by weight until no source is above. Rates: for each source the document rates r >= 0 that stay closest to 1 in
relative entropy, subject to sum(r * size) = target and r <= cap, are exponentially tilted: r = min(cap, exp(l * x)),
x the size over the source's mean size. The dual in l is convex; safeguarded Newton steps solve it for all sources at
once, each step one aggregation over the (source, size, documents) histogram. Sums are exact decimals, so that reruns
agree. Rounding: in buckets of bounded size, from the longest document down, each takes the whole copies (0 to cap)
that bring the running total nearest to what the rates have asked for so far; the rest is carried to shorter ones.

Defined results: null text has size 0, and a size of 0 takes 0; a null source is a source of its own, last in order;
repeated ids are separate documents; a source without words has target 0; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, has_columns, materialize, widened, word_count, worker_cache

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 60
CLOSE = 1e-7
BUCKET = 2_000


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """totals (src, size) plus weight and target.

    Filling by ratio: a source is full once the common rate reaches cap * size / weight, so that in ascending order of
    size / weight the full sources are a prefix. The window runs over one row a source.
    """
    order = Window.orderBy(F.col("src").isNull(), F.col("src").cast("binary"))
    w = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ratio = Window.orderBy(F.col("size") / F.col("weight"), F.col("src").isNull(), F.col("src"))
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = w.withColumn("_all", F.sum("size").over(every)).withColumn("_left", F.col("_all") - F.coalesce(F.sum(F.col("size") * cap).over(before), F.lit(0))).withColumn("_weights", F.sum("weight").over(after))
    rate = F.col("_left") / F.col("_weights")
    w = w.withColumn("_rate", rate).withColumn("_free", F.col("_rate") * F.col("weight") < F.col("size") * cap)
    w = w.withColumn("_level", F.min(F.when(F.col("_free"), F.struct(F.col("size") / F.col("weight"), F.col("_rate"))).otherwise(None)).over(every)["_rate"])
    target = F.when(F.col("_free"), F.col("_level") * F.col("weight")).otherwise(F.col("size") * F.lit(float(cap)))
    return w.select("src", "size", "weight", F.least(target, F.col("size") * F.lit(float(cap))).alias("target"))


def tilts(hist: DataFrame, totals: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(src, mean, tilt, full) for totals (src, size, n, target): the dual's solution. full: the target is the cap."""
    exact = lambda c: F.sum(c.cast("decimal(38,9)"))
    state = totals.select(
        "src", "target", (F.col("size") / F.col("n")).alias("mean"), (F.col("target") >= F.col("size") * F.lit(cap * (1 - 1e-9))).alias("full"),
        F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("off"),
    )
    state = materialize(state)
    for _ in range(steps):
        x = F.col("len") / F.col("mean")
        z = F.col("tilt") * x
        rate = F.exp(F.least(z, F.lit(log(cap))))
        part = hist.join(state.where(~F.col("full")), F.col("src").eqNullSafe(F.col("hsrc")))
        sums = part.groupBy("src").agg(exact(rate * F.col("len") * F.col("docs")).cast("double").alias("got"), exact(F.when(z < log(cap), rate * F.col("len") * x * F.col("docs")).otherwise(0.0)).cast("double").alias("slope"))
        now = state.join(sums.withColumnRenamed("src", "gsrc"), F.col("src").eqNullSafe(F.col("gsrc")), "left")
        # Newton on log(got) = log(target), which has the same root and is nearer to a line; bisection where a step leaves the bracket
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        high = F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + F.when(F.col("slope") > 0, F.col("got") / F.col("slope") * F.ln(F.col("target") / F.col("got")))
        wide = F.col("tilt") + F.when(F.col("got") < F.col("target"), F.lit(1.0)).otherwise(F.lit(-1.0)) * F.greatest(F.lit(1.0), F.abs("tilt"))
        middle = F.when((low > float("-inf")) & (high < float("inf")), (low + high) / 2).otherwise(wide)
        step = F.when((newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= 8 * F.greatest(F.lit(1.0), F.abs("tilt"))), newton).otherwise(middle)
        off = F.when(F.col("got").isNull(), F.lit(0.0)).otherwise(F.abs(F.col("got") - F.col("target")) / F.col("target"))
        done = off < CLOSE
        state = materialize(now.select("src", "target", "mean", "full", F.when(F.col("got").isNull() | done, F.col("tilt")).otherwise(step).alias("tilt"), low.alias("lo"), high.alias("hi"), off.alias("off")))
        worst = state.agg(F.max(F.when((F.col("hi") - F.col("lo")) > 1e-12 * (1 + F.abs("tilt")), F.col("off")))).first()[0]
        if worst is None or worst < CLOSE:
            break
    else:
        raise ValueError(f"the tilts did not converge in {steps} steps (off by {worst:.3g} of a target)")
    return state.select("src", "mean", "tilt", "full")


def _round(cap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket and, within it, from the longest document down."""
        worker_cache("mixing")
        key, carry = None, 0.0
        for pdf in frames:
            copies = []
            for k, size, rate in zip(pdf["_key"].tolist(), pdf["size"].tolist(), pdf["rate"].tolist(), strict=True):
                if k != key:
                    key, carry = k, 0.0
                c = 0
                if size:
                    carry += rate * size
                    c = min(cap, max(0, int(carry / size + 0.5)))
                    carry -= c * size
                copies.append(c)
            yield pdf.drop(columns=["_key", "rate"]).assign(copies=copies)

    return run


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """For each row: doc_id, src, size, source_size, target, copies (0 to cap), taken (copies * size)."""
    has_columns(docs, doc_id, source, text)
    sized = materialize(widened(docs).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("src"), word_count(F.col(text)).alias("size")))
    hist = materialize(sized.groupBy(F.col("src").alias("hsrc"), F.col("size").alias("len")).agg(F.count(F.lit(1)).alias("docs")))
    totals = hist.groupBy(F.col("hsrc").alias("src")).agg(F.sum(F.col("len") * F.col("docs")).alias("size"), F.sum("docs").alias("n"))
    goals = materialize(source_targets(totals, weights, cap).join(totals.select(F.col("src").alias("_s"), "n"), F.col("src").eqNullSafe(F.col("_s"))).drop("_s"))
    solved = tilts(hist.where("len > 0"), goals.where("size > 0"), cap)
    plan = materialize(
        goals.join(solved.withColumnRenamed("src", "_s"), F.col("src").eqNullSafe(F.col("_s")), "left")
        .select(F.col("src").alias("_s"), F.col("size").alias("source_size"), "target", "mean", "tilt", "full", F.ceil(F.col("n") / F.lit(BUCKET)).alias("_buckets"))
    )
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(log(cap)))))
    dealt = (
        sized.join(plan, F.col("src").eqNullSafe(F.col("_s")))
        .withColumn("_key", F.xxhash64("src", F.col("src").isNull(), F.pmod(F.xxhash64("doc_id", "size"), "_buckets")))
        .select("doc_id", "src", "size", "source_size", "target", rate.alias("rate"), "_key")
        .repartition("_key").sortWithinPartitions("_key", F.desc("size"), F.xxhash64("doc_id"), "doc_id")
    )
    schema = dealt.drop("_key", "rate").withColumn("copies", F.lit(0)).schema
    out = dealt.mapInPandas(_round(cap), schema)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with each row repeated as often as the mix takes it. Rows of an id are matched by their size; rows of equal
    id and size share the copies of all of them. Texts move once, to meet their copies; only such repeated keys move again."""
    i, s, n, total, rows, turn, mine, each = (fresh(docs, f"_mix_{x}") for x in ("id", "src", "size", "sum", "rows", "turn", "mine", "each"))
    copies = materialize(mix(docs, doc_id, source, text, weights, cap).groupBy(F.col("doc_id").alias(i), F.col("src").alias(s), F.col("size").alias(n)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows)))
    joined = docs.join(copies.where(F.col(total) > 0), F.col(doc_id).eqNullSafe(F.col(i)) & F.col(source).eqNullSafe(F.col(s)) & (word_count(F.col(text)) == F.col(n)))
    once = joined.where(F.col(rows) == 1).withColumn(mine, F.col(total))
    shared = joined.where(F.col(rows) > 1).withColumn(turn, F.row_number().over(Window.partitionBy(i, s, n).orderBy(F.col(text))))
    upto = lambda k: F.floor(F.col(total) * k / F.col(rows))
    shared = shared.withColumn(mine, upto(F.col(turn)) - upto(F.col(turn) - 1)).where(F.col(mine) > 0).drop(turn)
    return once.unionByName(shared).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(mine).cast("int")))).select(*docs.columns)
