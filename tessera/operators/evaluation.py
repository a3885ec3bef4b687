"""Evaluation as aggregate queries: plans and judgements from JSON, capability and tool metrics, retrieval metrics, scores."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import bind, first_of

# Servers, their tools, and the tools' arguments (required, optional).
TOOLS = {
    "weather": ("get_current_weather", "get_weather_forecast"),
    "places": ("search_place", "get_distance_between_places"),
}
ARGUMENTS = {
    "get_current_weather": (("location",), ("days",)),
    "get_weather_forecast": (("location", "days"), ()),
    "search_place": (("query",), ("country_code",)),
    "get_distance_between_places": (("origin", "destination"), ("country_code",)),
}
CAPABILITIES = ("rag", "weather", "places")
DIMENSIONS = ("correctness", "faithfulness", "relevance")
MAX_CALLS, MIN_DAYS, MAX_DAYS = 2, 1, 7


def _kind(v: Column, path: str) -> Column:
    """The schema of a variant's field, null where it is missing or null."""
    return F.nullif(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def parse_plan(json: Column) -> Column:
    """struct<error, use_rag, rag_query, tool_calls>: the first breach of the plan's contract, or the plan.

    Numbers are told from strings and booleans by the variant's own types.
    """

    def check_call(c: Column) -> Column:
        server, tool = _text(c, "$.server"), _text(c, "$.tool")
        known = F.lit(False)
        for s, tools in TOOLS.items():
            known = known | ((server == s) & tool.isin(*tools))
        checks: list[tuple[Column, Column | str]] = [
            (~F.coalesce(_kind(c, "$").startswith("OBJECT"), F.lit(False)), "each tool call must be an object"),
            (~F.coalesce(server.isin(*TOOLS), F.lit(False)), "unknown server"),
            (~F.coalesce(known, F.lit(False)), "unknown tool for the server"),
            (~F.coalesce(_kind(c, "$.arguments").startswith("OBJECT"), F.lit(False)), "arguments must be an object"),
        ]
        for name, (required, optional) in ARGUMENTS.items():
            mine = tool == name
            given = F.map_filter(F.coalesce(F.from_json(F.to_json(F.try_variant_get(c, "$.arguments", "variant")), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: v.isNotNull())
            extra = F.array_except(F.map_keys(given), F.array(*[F.lit(x) for x in (*required, *optional)]))
            checks.append((mine & (F.size(extra) > 0), F.concat(F.lit(f"{name}: unexpected arguments "), F.array_join(F.array_sort(extra), ", "))))
            for arg in required:
                at = f"$.arguments.{arg}"
                checks.append((mine & _kind(c, at).isNull(), f"{name}: missing required argument {arg}"))
                if arg == "days":
                    days = F.try_variant_get(c, at, "long")
                    checks.append((mine & ~F.coalesce((_kind(c, at) == "BIGINT") & days.between(MIN_DAYS, MAX_DAYS), F.lit(False)), f"{name}: days must be an integer between {MIN_DAYS} and {MAX_DAYS}"))
                else:
                    checks.append((mine & ~F.coalesce(F.trim(_text(c, at)) != "", F.lit(False)), f"{name}: {arg} must be a non-empty string"))
            if "country_code" in optional:
                code = "$.arguments.country_code"
                checks.append((mine & _kind(c, code).isNotNull() & ~F.coalesce(_text(c, code).rlike("^[A-Za-z]{2}$"), F.lit(False)), "country_code must be null or a two-letter code"))
        return first_of(checks)

    def clean_call(c: Column) -> Column:
        raw = F.from_json(F.to_json(F.try_variant_get(c, "$.arguments", "variant")), "map<string,string>")
        kept = F.map_filter(raw, lambda k, v: v.isNotNull() & ~((_text(c, "$.tool") == "get_current_weather") & (k == "days")))
        return F.struct(_text(c, "$.server").alias("server"), _text(c, "$.tool").alias("tool"), F.transform_values(kept, lambda k, v: F.when(k == "country_code", F.lower(v)).otherwise(F.trim(v))).alias("arguments"))

    def plan(v: Column) -> Column:
        calls = F.try_variant_get(v, "$.tool_calls", "array<variant>")
        n = F.coalesce(F.size(calls), F.lit(0))
        servers = F.transform(calls, lambda c: _text(c, "$.server"))
        use = F.try_variant_get(v, "$.use_rag", "boolean")
        query = F.nullif(F.trim(_text(v, "$.rag_query")), F.lit(""))
        bad_call = F.get(F.filter(F.transform(calls, check_call), lambda e: e.isNotNull()), F.lit(0))
        error = first_of(
            [
                (v.isNull(), "not valid JSON"),
                (~F.coalesce(_kind(v, "$").startswith("OBJECT"), F.lit(False)), "the plan must be a JSON object"),
                (~F.coalesce(_kind(v, "$.use_rag") == "BOOLEAN", F.lit(False)), "use_rag must be true or false"),
                (~F.coalesce(_kind(v, "$.tool_calls").startswith("ARRAY"), F.lit(False)), "tool_calls must be a list"),
                (n > MAX_CALLS, f"at most {MAX_CALLS} tool calls are allowed"),
                (bad_call.isNotNull(), bad_call),
                (F.size(F.array_distinct(servers)) < n, "at most one tool call per server is allowed"),
                (~use & (n == 0), "the plan uses no capability"),
                (use & (n > 0) & query.isNull(), "rag_query is required when retrieval is combined with tool calls"),
            ]
        )
        ok = error.isNull()
        return F.struct(error.alias("error"), F.when(ok, use).alias("use_rag"), F.when(ok & use, query).alias("rag_query"), F.when(ok, F.transform(calls, clean_call)).alias("tool_calls"))

    return bind(F.try_parse_json(json), plan)


def plan_with_retry(first: Column, retry: Column) -> Column:
    """The plan of the first output, else of the retry; the retry's error if both fail."""
    return bind(parse_plan(first), lambda p: F.when(p["error"].isNull(), p).otherwise(parse_plan(retry)))


def parse_judgement(json: Column, max_chars: int = 600) -> Column:
    """struct<error, correctness, faithfulness, relevance>: exactly three dimensions, each an integer score of 0 to 2
    (not a boolean or a fraction) and a reason that is neither empty nor too long."""

    def judge(v: Column) -> Column:
        keys = F.array_sort(F.json_object_keys(json))
        checks: list[tuple[Column, Column | str]] = [
            (v.isNull(), "not valid JSON"),
            (~F.coalesce(_kind(v, "$").startswith("OBJECT"), F.lit(False)), "an object is expected"),
            (~F.coalesce(keys == F.array(*[F.lit(d) for d in sorted(DIMENSIONS)]), F.lit(False)), "keys must be exactly the three dimensions"),
        ]
        for d in DIMENSIONS:
            inner = F.array_sort(F.json_object_keys(F.to_json(F.try_variant_get(v, f"$.{d}", "variant"))))
            score, reason = F.try_variant_get(v, f"$.{d}.score", "long"), _text(v, f"$.{d}.reason")
            checks += [
                (~F.coalesce(inner == F.array(F.lit("reason"), F.lit("score")), F.lit(False)), f"{d} must have exactly score and reason"),
                (~F.coalesce((_kind(v, f"$.{d}.score") == "BIGINT") & score.between(0, 2), F.lit(False)), f"{d}.score must be the integer 0, 1 or 2"),
                (~F.coalesce(F.trim(reason) != "", F.lit(False)), f"{d}.reason must be a non-empty string"),
                (F.char_length(reason) > max_chars, f"{d}.reason is too long"),
            ]
        error = first_of(checks)
        part = lambda d: F.when(error.isNull(), F.struct(F.try_variant_get(v, f"$.{d}.score", "int").alias("score"), F.trim(_text(v, f"$.{d}.reason")).alias("reason"))).alias(d)
        return F.struct(error.alias("error"), *[part(d) for d in DIMENSIONS])

    return bind(F.try_parse_json(json), judge)


def predicted_capabilities(success: Column, use_rag: Column, tool_calls: Column) -> Column:
    """struct<rag, weather, places>; all false where planning failed."""
    ok = F.coalesce(success, F.lit(False))
    has = lambda s: F.coalesce(F.exists(tool_calls, lambda c: c["server"] == s), F.lit(False))
    return F.struct((ok & F.coalesce(use_rag, F.lit(False))).alias("rag"), (ok & has("weather")).alias("weather"), (ok & has("places")).alias("places"))


def selected_tool(success: Column, tool_calls: Column, server: str) -> Column:
    return F.when(F.coalesce(success, F.lit(False)), F.get(F.filter(tool_calls, lambda c: c["server"] == server), F.lit(0))["tool"])


def capability_match(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", category: str = "category") -> DataFrame:
    """(category, correct, total, value); the row of null category is the whole."""
    hit = F.col(gold) == F.col(predicted)
    out = rows.rollup(category).agg(F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("value", F.try_divide(F.col("correct"), F.col("total")))


def planner_check(rows: DataFrame, expected: str = "expected", predicted: str = "predicted", category: str = "category") -> DataFrame:
    """(category, matches, total) of a development set's labels; a failed plan (null) matches nothing. The row of null
    category is the whole."""
    hit = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    return rows.rollup(category).agg(F.count_if(hit).alias("matches"), F.count(F.lit(1)).alias("total"))


def capability_label(rag: Column, weather: Column, places: Column) -> Column:
    """The capabilities that are used, as one label."""
    return F.coalesce(F.nullif(F.concat_ws("+", F.when(rag, "rag"), F.when(weather, "weather"), F.when(places, "places")), F.lit("")), F.lit("none"))


def joined_alike(left: DataFrame, right: DataFrame, key: str, same: str) -> DataFrame:
    """Left with right's other columns by key. Fails if a key of left has no row on the right, or if same differs."""
    other = right.select(F.col(key).alias("_key"), F.col(same).alias("_same"), *[c for c in right.columns if c not in (key, same)])
    both = left.join(other, F.col(key) == F.col("_key"), "left")
    checked = F.when(F.col("_key").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).when(~F.col(same).eqNullSafe(F.col("_same")), F.raise_error(F.concat(F.lit(f"{same} differs for "), F.col(key).cast("string")))).otherwise(F.col(same))
    return both.withColumn(same, checked).drop("_key", "_same")


def tool_accuracy(rows: DataFrame, needs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(server, correct, total, value) over the questions that need a server; the row of null server is the whole.

    needs: (server, column of the expected tool or null, column of the selected tool).
    """
    each = F.array(*[F.struct(F.lit(s).alias("server"), F.col(e).alias("expected"), F.col(c).alias("chosen")) for s, e, c in needs])
    flat = rows.select(F.explode(each).alias("x")).select("x.*").where(F.col("expected").isNotNull())
    out = flat.rollup("server").agg(F.count_if(F.col("expected").eqNullSafe(F.col("chosen"))).alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("value", F.try_divide(F.col("correct"), F.col("total")))


def retrieval_scores(gold: Column, found: Column) -> Column:
    """struct<hit, recall, reciprocal_rank, first_rank> of distinct gold ids among the found, in rank order; null found scores 0."""
    want = F.array_distinct(gold)
    got = F.coalesce(found, F.array().cast("array<string>"))
    both = F.size(F.array_intersect(want, got))
    ranks = F.filter(F.transform(want, lambda g: F.array_position(got, g)), lambda r: r > 0)
    first = F.when(F.size(ranks) > 0, F.array_min(ranks))
    return F.struct((both > 0).cast("int").alias("hit"), F.coalesce(F.try_divide(both, F.size(want)), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(F.lit(1.0), first), F.lit(0.0)).alias("reciprocal_rank"), first.alias("first_rank"))


def retrieval_summary(rows: DataFrame, scores: str = "scores") -> DataFrame:
    """Questions, hits, mean hit, macro recall, mean reciprocal rank."""
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.sum(f"{scores}.hit").alias("hits"), F.avg(f"{scores}.hit").alias("hit_rate"), F.avg(f"{scores}.recall").alias("macro_recall"), F.avg(f"{scores}.reciprocal_rank").alias("mrr"))


def agency_notes(success: Column, gold: Column, predicted: Column) -> Column:
    """What the plan lacks or adds."""
    notes = []
    for c in CAPABILITIES:
        notes += [F.when(gold[c] & ~predicted[c], f"{c} capability absent although gold=true"), F.when(predicted[c] & ~gold[c], f"{c} capability added although gold=false")]
    return F.when(~F.coalesce(success, F.lit(False)), F.array(F.lit("planner failed: no plan"))).otherwise(F.array_compact(F.array(*notes)))


def errors_by_stage(rows: DataFrame, key: str, stage: str) -> DataFrame:
    """(stage, key, n) of the rows with an error; n counts those of the stage. Ids are rows, as a stage may have any number."""
    failed = rows.where(F.col(stage).isNotNull()).select(stage, key)
    return failed.join(failed.groupBy(stage).agg(F.count(F.lit(1)).alias("n")), stage)


def score_summary(rows: DataFrame, score: str, top: int = 2) -> list[Column]:
    """A10: aggregates of a 0..top score: counts, shares, total, mean."""
    s = F.col(score)
    n = F.count(s)
    counts = [F.count_if(s == i).alias(f"{score}_{i}") for i in range(top + 1)]
    shares = [(F.count_if(s == i) * 100.0 / n).alias(f"{score}_{i}_percent") for i in range(top + 1)]
    return [*counts, *shares, F.sum(s).alias(f"{score}_total"), F.avg(s).alias(f"{score}_mean")]


def compare_scores(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A10: both summaries, and how often a is better than, ties with and is worse than b."""
    x, y = F.col(a), F.col(b)
    return rows.agg(*score_summary(rows, a), *score_summary(rows, b), F.count_if(x > y).alias("better"), F.count_if(x == y).alias("tie"), F.count_if(x < y).alias("worse"), (F.avg(x) - F.avg(y)).alias("mean_difference"))


def judge_summary(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS, category: str = "category") -> DataFrame:
    """(dimension, category, n, total, mean, n0, n1, n2); null category is the whole."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in dimensions])
    flat = rows.select(category, F.explode(each).alias("x")).select(category, "x.*")
    out = flat.groupingSets([["dimension", category], ["dimension"]], "dimension", category)
    s = F.col("score")
    return out.agg(F.count(s).alias("n"), F.sum(s).alias("total"), F.avg(s).alias("mean"), *[F.count_if(s == i).alias(f"n{i}") for i in range(3)])


def five_numbers(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """A2: min, quartiles by linear interpolation, mean and max, to one decimal."""
    p = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.min(value).alias("min"), p.alias("_p"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    r = lambda c: F.bround(c, 1)
    return out.select(*by, "min", r(F.get("_p", F.lit(0))).alias("p25"), r(F.get("_p", F.lit(1))).alias("median"), r(F.col("mean")).alias("mean"), r(F.get("_p", F.lit(2))).alias("p75"), "max")


def item_problems(items: DataFrame, categories: Sequence[str], per_category: int, capability_total: int) -> DataFrame:
    """(id, problem): unique ids, order, the size of each category, the total of each capability, tools and gold chunks
    that fit the capabilities. items: id, category, rag, weather, places, expected_weather, expected_places, gold_chunks."""
    again = F.count(F.lit(1)).over(Window.partitionBy("id"))
    fits = []
    for s in ("weather", "places"):
        fits.append(F.when(F.col(s) & ~F.coalesce(F.col(f"expected_{s}").isin(*TOOLS[s]), F.lit(False)), f"{s}: expected tool missing or unknown"))
        fits.append(F.when(~F.col(s) & F.col(f"expected_{s}").isNotNull(), f"{s}: expected tool without the capability"))
    fits.append(F.when(F.col("rag") != (F.coalesce(F.size("gold_chunks"), F.lit(0)) > 0), "rag: gold chunks do not fit the capability"))
    fits.append(F.when(~F.col("category").isin(*categories), "unknown category"))
    fits.append(F.when(again > 1, "duplicate id"))
    each = items.select("id", F.array_compact(F.array(*fits)).alias("p")).select("id", F.explode("p").alias("problem"))
    sizes = items.groupBy("category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != per_category).select(F.col("category").alias("id"), F.concat(F.lit("category has "), "n", F.lit(" items")).alias("problem"))
    totals = items.agg(*[F.count_if(F.col(c)).alias(c) for c in CAPABILITIES]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).alias("n")) for c in CAPABILITIES])).alias("x")).select("x.*")
    wrong = totals.where(F.col("n") != capability_total).select("id", F.concat(F.lit("capability has "), "n", F.lit(" items")).alias("problem"))
    return each.unionByName(sizes).unionByName(wrong)


def run_problems(items: DataFrame, records: DataFrame) -> DataFrame:
    """(id, problem): every item has one record with its position and an unchanged gold snapshot, and no record is left over.
    items, records: id, position, gold."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    both = items.alias("i").join(records.withColumn("_n", n).alias("r"), "id", "full_outer")
    check = first_of([
        (F.col("r._n").isNull(), "no record"), (F.col("i.position").isNull(), "record without an item"), (F.col("r._n") > 1, "more than one record"),
        (~F.col("i.position").eqNullSafe(F.col("r.position")), "out of order"), (~F.col("i.gold").eqNullSafe(F.col("r.gold")), "gold snapshot differs"),
    ])
    return both.select("id", check.alias("problem")).where(F.col("problem").isNotNull()).distinct()


def hash_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, problem) of names whose digests differ or that one side lacks. Both: name, digest."""
    both = expected.select("name", F.col("digest").alias("e")).join(actual.select("name", F.col("digest").alias("a")), "name", "full_outer")
    check = first_of([(F.col("a").isNull(), "missing"), (F.col("e").isNull(), "unexpected"), (F.col("e") != F.col("a"), "changed")])
    return both.select("name", check.alias("problem")).where(F.col("problem").isNotNull())


def content_digest(content: Column) -> Column:
    """SHA-256 of a text or of bytes, as lower-case digits."""
    return F.sha2(content.cast("binary"), 256)


def tree_digest(files: DataFrame, path: str, content: str) -> DataFrame:
    """One digest over all files: SHA-256 of the lines "digest  path" in path order. The digest runs over one stream, so
    the lines (not the contents) pass through the driver, partition by partition."""
    lines = files.select(F.col(path).alias("p"), F.concat(content_digest(F.col(content)), F.lit("  "), F.col(path), F.lit("\n")).alias("line")).orderBy("p").select("line")
    digest = hashlib.sha256()
    for row in lines.toLocalIterator():
        digest.update(row["line"].encode())
    return files.sparkSession.createDataFrame([(digest.hexdigest(),)], "digest string")
