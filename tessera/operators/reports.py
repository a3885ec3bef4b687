"""Reports as one text, put together from aggregated tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Section:
    """A heading, a paragraph, and a table of columns, whose rows come by `order`. Values are told as text, nulls as a dash."""

    heading: str
    table: DataFrame | None = None
    columns: Sequence[str] = ()
    order: Sequence[str] = ()
    text: str = ""


def cell(value: Column) -> Column:
    """A table's cell: bars and line breaks would end it."""
    return F.coalesce(F.regexp_replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), r"\s+", " "), F.lit("-"))


def render(spark, title: str, sections: Sequence[Section]) -> DataFrame:
    """(report): Markdown text with the sections in their order.

    Each table's lines are made where its rows are, and carry (section, rows' order, line); the text is one ordered
    string aggregate over the lines of all sections, which are as many as aggregated rows."""
    fixed, parts = [], []
    for i, s in enumerate(sections):
        lines = [f"## {i + 1}. {s.heading}", ""] + ([s.text, ""] if s.text else [])
        if s.table is not None:
            lines += ["| " + " | ".join(s.columns) + " |", "|" + "---|" * len(s.columns)]
            line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in s.columns]), F.lit(" |"))
            rank = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in s.order])) if s.order else F.lit("")
            parts.append(s.table.select(F.lit(i).alias("section"), F.lit(1).alias("part"), rank.alias("rank"), F.lit(0).alias("at"), line.alias("line")))
        fixed += [(i, 0, "", k, x) for k, x in enumerate(lines)] + [(i, 2, "", 0, "")] * (i + 1 < len(sections))
    head = spark.createDataFrame([(-1, 0, "", 0, f"# {title}"), (-1, 0, "", 1, ""), *fixed], "section int, part int, rank string, at int, line string")
    rows = reduce(DataFrame.unionByName, parts, head)
    return rows.agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY section, part, rank, at, line)").alias("report"))
