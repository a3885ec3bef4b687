"""Quality rules as a short-circuit cascade, in native expressions only.

Each rule is a reject condition over the text. A bounded sample gives each rule's cost (seconds a row over a bare
scan) and selectivity (share of rows that it rejects); rules then run in order of rejection per cost inside one CASE
expression, which Spark evaluates lazily, so that a text that an early rule rejects pays for no later rule. The order
changes the work, never the verdict. Of a scan of more than SAMPLE_FILES files, the sample is drawn from about that many, by a hash of
their paths, so that it doesn't cost a second reading of all texts; every rule is judged on every row in any case.

Defined results: a null text counts as empty; an empty text has no words and fails the length rule; rows with equal
or null ids are judged row by row; other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, has_columns, let, materialize, widened, word_array, word_count

SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 2_000
SAMPLE_FILES = 64


def line_array(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(text: Column) -> Column:
    return F.coalesce(F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    return let(line_array(text), lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long"))


def repeated_words(text: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hash. Sorted with their positions, equal ones are neighbours; the sorted positions
    p of repeated windows then cover sum(min(3, next p - p)) words.
    """

    def windows(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(h: Column) -> Column:
        twins = let(
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda z: F.array_sort(F.transform(F.filter(z, lambda e, k: (e["h"] == F.get(z, k - 1)["h"]) | (e["h"] == F.get(z, k + 1)["h"])), lambda e: e["i"])),
        )
        return let(twins, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    count = let(word_array(text), lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))
    return F.coalesce(count, F.lit(0)).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Column  # never null


def default_rules(text: Column, counted: dict[str, Column] | None = None) -> list[Rule]:
    """Reject conditions of the method, all ratios of whole numbers. counted: columns that hold n_words, word_chars, n_symbols
    and n_dup_lines already, which are then not counted again."""
    have = counted or {}
    words = lambda use: use(have["n_words"]) if have else let(word_count(text), use)
    chars, symbols = have.get("word_chars", word_chars(text)), have.get("n_symbols", symbol_count(text))
    lines = (lambda use: let(line_array(text), lambda s: use(F.size(s), have["n_dup_lines"]))) if have else (lambda use: let(line_array(text), lambda s: use(F.size(s), F.size(s) - F.size(F.array_distinct(s)))))
    return [
        Rule("symbols", words(lambda n: symbols * 10 > n)),
        Rule("word_length", words(lambda n: let(chars, lambda c: (c < n * 2) | (c > n * 12)))),
        Rule("shouting", let(F.coalesce(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0)), lambda n: F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")), F.lit(0)) * 10 > n * 3)),
        Rule("letterless_words", words(lambda n: F.coalesce(F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}")), F.lit(0)) * 10 < n * 7)),
        Rule("duplicate_lines", lines(lambda n, dup: dup * 2 > n)),
    ]


def base_rules(text: Column) -> list[Rule]:
    return [
        Rule("short", word_count(text) < 50),
        Rule("repeated_words", let(word_count(text), lambda n: repeated_words(text) * 100 > n * 50)),
    ]


def some_files(docs: DataFrame, most: int = SAMPLE_FILES) -> DataFrame:
    """The rows of about `most` files of docs, by a hash of their paths, if it is a scan of more; else docs."""
    n = len(docs.inputFiles())
    if n <= most:
        return docs
    try:
        return docs.where(F.pmod(F.xxhash64("_metadata.file_path"), F.lit(n)) < most)
    except AnalysisException:  # joined or aggregated: no row has one file
        return docs


def ordered(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost, both measured over a random sample of about sample_rows texts."""
    t = F.col(text)
    docs = some_files(docs)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = materialize(docs.select(t).sample(share, seed=9).repartition(4))
    rates = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r.reject).alias(r.name) for r in rules]).first()
    if not rates["n"]:
        return list(rules)

    def seconds(*cols: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.select(F.length(t), *cols).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    bare = seconds()
    cost = {r.name: max(seconds(r.reject) - bare, 1e-3) for r in rules}
    return sorted(rules, key=lambda r: (-rates[r.name] / cost[r.name], r.name))


def first_reject(rules: list[Rule]) -> Column:
    """The name of the first rule, in this order, that rejects the row; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.reject, F.lit(r.name)).otherwise(out)
    return out


def quality_filter(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of docs that no rule rejects, with docs' columns."""
    has_columns(docs, text)
    rules = [*base_rules(F.col(text)), *default_rules(F.col(text))] if rules is None else rules
    return widened(docs).where(first_reject(ordered(docs, rules, text, sample_rows)).isNull())


def quality_report(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept (existing columns of
    these names are replaced)."""
    has_columns(docs, text)
    t = F.col(text)
    order = [r.name for r in ordered(docs, default_rules(t), text, sample_rows)]
    docs = out = widened(docs)
    counts = {"n_words": word_count(t), "word_chars": word_chars(t), "n_symbols": symbol_count(t), "n_dup_lines": duplicate_lines(t), "n_repeat_words": repeated_words(t)}
    names = {c: fresh(docs, f"_{c}") for c in counts}
    out = out.select("*", *[e.alias(names[c]) for c, e in counts.items()])
    failed = (F.col(names["n_words"]) < 50) | (F.col(names["n_repeat_words"]) * 100 > F.col(names["n_words"]) * 50)
    rules = {r.name: r for r in default_rules(t, {c: F.col(n) for c, n in names.items()})}
    kept = F.when(failed, F.lit(False)).otherwise(first_reject([rules[name] for name in order]).isNull())
    rest = [c for c in docs.columns if c.lower() not in {*counts, "base_failed", "kept"}]
    return out.select(*rest, *[F.col(n).alias(c) for c, n in names.items()], failed.alias("base_failed"), kept.alias("kept"))
