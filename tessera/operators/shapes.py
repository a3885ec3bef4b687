"""The shape of JSON records, compared with an expected one path by path.

Records are parsed to VARIANT once. The walk goes down the expected shape, a level at a time: the values at a level's paths
are rows, which are checked and opened further by built-in functions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "$"


def kind(value: Column) -> Column:
    """object, array, int, number, string, boolean or null of a VARIANT; other types by Spark's name in lower case."""
    told = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = {"OBJECT": "object", "ARRAY": "array", "BIGINT": "int", "DECIMAL": "number", "DOUBLE": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), told), F.lower(told))


def _children(expected: Mapping[str, str], path: str) -> dict[str, str]:
    """{name: path} of the members that an object at path may have."""
    head = f"{path}."
    return {p[len(head) :]: p for p in expected if p.startswith(head) and "." not in p[len(head) :] and not p.endswith("[]")}


def _named(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def shape_problems(records: DataFrame, key: str, text: str, expected: Mapping[str, str]) -> DataFrame:
    """(key, path, problem) of every breach of the shape; text that isn't JSON, or is null, is one at the root.

    expected: path -> types, such as {"$": "object", "$.id": "int", "$.top": "array?", "$.top[]": "object", "$.top[].rank":
    "int|null"}. A path ends in [] for an array's elements; types are kind()'s, several with | between; ? at the end: the member may
    be missing. An int is a number, too. Problems: missing, added, and "<found>, not <types>". What lies under a breach isn't walked.
    Members whose names have a dot or a bracket can't be named in expected, and are reported as added."""
    types = {p: t.rstrip("?") for p, t in expected.items()}
    base = records.select(F.col(key).alias("key"), F.try_parse_json(F.col(text)).alias("v"))
    found = [base.where("v is null").select("key", F.lit(ROOT).alias("path"), F.lit("not JSON").alias("problem"))]
    level, now = [ROOT], base.where("v is not null").select("key", F.lit(ROOT).alias("path"), "v")
    while level:
        at = lambda f: reduce(lambda c, p: c.when(F.col("path") == p, f(p)), level[1:], F.when(F.col("path") == level[0], f(level[0])))  # noqa: B023, E731
        allows = lambda p: [*types[p].split("|"), *(["int"] if "number" in types[p].split("|") else [])]
        typed = now.withColumn("kind", kind(F.col("v")))
        fits = at(lambda p: F.col("kind").isin(*allows(p)))  # noqa: B023
        typed = typed.withColumn("fits", fits).withColumn("members", F.when(F.col("kind") == "object", F.json_object_keys(F.to_json("v"))))
        wrong = F.when(~F.col("fits"), F.array(F.struct("path", F.concat("kind", F.lit(", not "), at(lambda p: F.lit(types[p]))).alias("problem"))))  # noqa: B023
        told = lambda names, what: F.transform(names, lambda n: F.struct(F.concat("path", F.lit("."), n).alias("path"), F.lit(what).alias("problem")))
        own = lambda p: _children(expected, p)
        missing = F.array_except(at(lambda p: _named([n for n, q in own(p).items() if not expected[q].endswith("?")])), F.col("members"))  # noqa: B023
        added = F.array_except(F.col("members"), at(lambda p: _named(list(own(p)))))  # noqa: B023
        inside = F.when(F.col("fits") & (F.col("kind") == "object"), F.concat(told(missing, "missing"), told(added, "added")))
        found.append(typed.select("key", F.inline(F.coalesce(wrong, inside, F.array().cast("array<struct<path:string,problem:string>>")))))
        get = lambda q, n: F.struct(F.lit(q).alias("path"), F.try_variant_get("v", f"$['{n}']", "variant").alias("v"))
        elements = lambda p: F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: F.struct(F.lit(f"{p}[]").alias("path"), x.alias("v")))
        none = F.array().cast("array<struct<path:string,v:variant>>")
        members = at(lambda p: F.array(*[get(q, n) for n, q in own(p).items()]) if own(p) else none)  # noqa: B023
        items = at(lambda p: elements(p) if f"{p}[]" in expected else none)  # noqa: B023
        below = F.when(F.col("kind") == "object", members).when(F.col("kind") == "array", items)
        now = typed.where("fits").select("key", F.inline(below)).where("v is not null")
        level = [q for p in level for q in [*own(p).values(), *([f"{p}[]"] if f"{p}[]" in expected else [])]]
    return reduce(DataFrame.unionByName, found)
