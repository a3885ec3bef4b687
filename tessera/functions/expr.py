"""Building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once. Without this the optimizer may copy a costly expression into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def problems(*checks: tuple[Column, Column | str]) -> Column:
    """array<string> of the messages whose condition holds (null counts as not)."""
    items = [F.when(c, F.lit(m) if isinstance(m, str) else m) for c, m in checks]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def first_of(checks: Iterable[tuple[Column, Column | str]]) -> Column:
    """The message of the first condition that holds, else null; conditions after it aren't evaluated."""
    out = F.lit(None).cast("string")
    for c, m in reversed(list(checks)):
        out = F.when(c, F.lit(m) if isinstance(m, str) else m).otherwise(out)
    return out


def alternation(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)
