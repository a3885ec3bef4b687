"""Global order without one task: positions of an ordered table, joins by position, and the first n of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import stored


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def positions(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "position", count: str | None = None) -> DataFrame:
    """df with the gapless 0-based position of each row, by ascending `order` (nulls first) within `by`, as column `name`,
    and the rows of its group as column `count` if named.

    Rows are dealt by ranges of (by, order), so that a large group lies in many partitions, sorted there and written once;
    a row's place in its partition is shifted by the counts of the group's earlier partitions. What is windowed is that
    table of counts, which has a row for each group and partition. Rows that are equal in `order` come in any order; they
    are told apart by their place in the source, so that very many of them are dealt out, too.
    """
    by = by or []
    tie, at, part, first, n, base, total = _free(df, "_tie", "_at", "_part", "_first", "_n", "_base", "_total")
    keys = [*by, *order, tie]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    runs = rows.groupBy(*by, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    before = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(*[F.col(k).alias(f"{k}{i}_of_run") for i, k in enumerate(by)], F.col(part).alias(f"{part}_of_run"), F.col(first), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base), F.sum(n).over(group).alias(total))
    same = rows[part] == bases[f"{part}_of_run"]
    for i, k in enumerate(by):
        same = same & rows[k].eqNullSafe(bases[f"{k}{i}_of_run"])
    out = rows.join(bases, same).withColumn(name, (F.col(at) - F.col(first) + F.col(base)).cast("long"))
    return out.select(*df.columns, name, *([F.col(total).alias(count)] if count else []))


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], name: str = "position") -> DataFrame:
    """Row i of left beside row i of right, each in its own order, with i as column `name`. Tables of unequal length are an
    error, which names the first position without a partner that is met, when the result is computed; clashing column names of right end in _right."""
    if name in left.columns or name in right.columns:
        raise ValueError(f"column {name} exists already")
    rows, others = positions(left, left_order, name=name), positions(right, right_order, name=name)
    own = {c.lower() for c in left.columns}
    others = others.select(name, *[F.col(c).alias(f"{c}_right" if c.lower() in own else c) for c in right.columns], F.lit(True).alias("_there"))
    both = rows.withColumn("_here", F.lit(True)).join(others, name, "full")
    message = F.concat(F.lit("row "), F.col(name).cast("string"), F.lit(" has no partner: the tables differ in length"))
    alone = F.col("_here").isNull() | F.col("_there").isNull()
    return both.withColumn(name, F.when(alone, F.raise_error(message)).otherwise(F.col(name))).drop("_here", "_there")


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in order, with their rank (from 1) as column `rank`. Spark keeps the first n of a group in each
    task before rows are exchanged, so that what a group sends is n rows a task, whatever its size."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be 1 to 1000, beyond which tasks no longer keep the first n alone; use positions()")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name", mark: str = "#") -> DataFrame:
    """df with column `out`: the name itself for the first row that has it, in order, and name, mark and 2, 3, ... for the others. As
    long as no name holds the mark, all are different. Names are numbered as positions() does it, so that one name may be
    that of any number of rows."""
    numbered = positions(df, order, [name], "_of_name")
    again = F.concat(F.col(name), F.lit(mark), (F.col("_of_name") + 1).cast("string"))
    return numbered.withColumn(out, F.when(F.col("_of_name") == 0, F.col(name)).otherwise(again)).drop("_of_name")
