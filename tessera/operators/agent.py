"""The expert agent over a table of questions, its record, and the judge of its answers.

Every step is a stage over all rows, and what it gave or why it failed is a column: the plan, the tools' answers, the
retrieval, the prompt, the answer. A row that fails goes through no later step, and no failure ends the job. Planner, tools,
retriever, generator and judge are injected; each is called once for a row that needs it, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import first_of, problems
from tessera.operators import evaluation as E
from tessera.operators.services import final_prompt
from tessera.sources.store import stored

CALLED = "struct<output:string,error:string>"
SERVERS = tuple(E.TOOLS)
ATTEMPTS = 2
# How an answer names where its data comes from.
SOURCES_TITLE = "Fontes:"
WEATHER_SOURCE = "Fonte meteorológica: Open-Meteo via Weather MCP"
PLACES_SOURCE = "Fonte geográfica: {} via Places MCP"
PLACES_ATTRIBUTION = "© OpenStreetMap contributors (data and geocoding via Nominatim)"


def called(function: Callable[..., str | None], *inputs: Column) -> Column:
    """struct<output, error> of an injected function; rows whose first input is null aren't asked and give null."""

    @F.pandas_udf(CALLED)
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for args in zip(*columns, strict=True):
            if args[0] is None:
                out.append((None, None))
                continue
            try:
                out.append((function(*args), None))
            except Exception as e:  # noqa: BLE001 a service's failure is a result
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["output", "error"])

    return run(*[c.cast("string") for c in inputs])


def planned(questions: DataFrame, planner: Callable[[str], str], question: str = "question") -> DataFrame:
    """Questions plus plan struct<error, use_rag, rag_query, tool_calls>. A second call is made only where the first gave no
    valid plan."""
    first = stored(questions.withColumn("_first", called(planner, F.col(question))))
    failed = E.parse_plan(F.col("_first.output"))["error"].isNotNull()
    open_ = stored(first.withColumn("_open", F.when(failed, F.col(question))))  # a function of Python takes columns, not the check itself
    again = stored(open_.withColumn("_again", called(planner, F.col("_open"))).drop("_open"))
    plan = E.plan_with_retry(F.col("_first.output"), F.col("_again.output"))
    reason = F.coalesce(F.when(plan["error"].isNotNull(), F.coalesce("_again.error", plan["error"])), F.lit(None).cast("string"))
    return stored(again.withColumn("plan", plan).withColumn("plan", F.col("plan").withField("error", reason)).drop("_first", "_again"))


def with_tools(rows: DataFrame, tool: Callable[[str, str, str], str], key: str = "id") -> DataFrame:
    """Rows plus tools map<server, struct<tool, arguments, output, error>>; tool is given server, tool and arguments (JSON)."""
    calls = rows.where("plan.error IS NULL").select(key, F.explode("plan.tool_calls").alias("c")).select(key, "c.server", "c.tool", F.to_json("c.arguments").alias("arguments"))
    asked = calls.withColumn("_r", called(tool, F.col("server"), F.col("tool"), F.col("arguments")))
    entry = F.struct("server", F.struct("tool", "arguments", F.col("_r.output").alias("output"), F.col("_r.error").alias("error")))
    found = stored(asked.groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.collect_list(entry)).alias("tools")))  # one call a server
    return rows.join(found, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def tool_error(tools: Column) -> Column:
    return first_of([(tools[s]["error"].isNotNull(), F.concat(F.lit(f"{s}: "), tools[s]["error"])) for s in SERVERS])


def answered(rows: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[str], str], today: Column, rag_prompt: Callable[[Column, Column, Column], Column], key: str = "id", question: str = "question") -> DataFrame:
    """Rows plus context, sources, prompt, answer and error struct<stage, message>.

    retrieve: (id, query) to (id, context, conflict_note, sources). A plan of retrieval alone takes the question as it stands
    and the retrieval prompt; any other takes the prompt with a block for each capability.
    """
    alone = F.col("plan.use_rag") & (F.size("plan.tool_calls") == 0)
    fine = F.col("plan.error").isNull() & tool_error(F.col("tools")).isNull()
    asked = rows.where(fine & F.col("plan.use_rag")).select(F.col(key).alias("id"), F.when(alone, F.col(question)).otherwise(F.coalesce("plan.rag_query", question)).alias("query"))
    found = retrieve(asked).select(F.col("id").alias("_k"), "context", "conflict_note", "sources")
    read = rows.join(found, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    rag = F.when(F.col("plan.use_rag"), F.concat_ws("\n\n", F.coalesce("context", F.lit("")), "conflict_note"))
    data = {s: F.col("tools")[s]["output"] for s in SERVERS}
    every = final_prompt(today, F.col(question), rag, data["weather"], data["places"])
    prompt = F.when(fine, F.when(alone, rag_prompt(F.col(question), F.coalesce("context", F.lit("")), F.col("conflict_note"))).otherwise(every))
    said = stored(read.withColumn("prompt", prompt).withColumn("_said", called(generate, F.col("prompt"))))
    parts = [
        F.col("_said.output"), F.when(F.col("sources").isNotNull(), F.concat(F.lit(f"{SOURCES_TITLE}\n"), "sources")),
        F.when(data["weather"].isNotNull(), F.lit(WEATHER_SOURCE)), F.when(data["places"].isNotNull(), F.format_string(PLACES_SOURCE.replace("{}", "%s"), F.coalesce(F.nullif(F.try_variant_get(F.try_parse_json(data["places"]), "$.attribution", "string"), F.lit("")), F.lit(PLACES_ATTRIBUTION)))),
    ]
    stage = first_of([(F.col("plan.error").isNotNull(), F.lit("planner")), *[(F.col("tools")[s]["error"].isNotNull(), F.lit(s)) for s in SERVERS], (F.col("_said.error").isNotNull() & alone, F.lit("rag_only")), (F.col("_said.error").isNotNull(), F.lit("generation"))])
    message = F.coalesce("plan.error", tool_error(F.col("tools")), "_said.error")
    error = F.when(stage.isNotNull(), F.struct(stage.alias("stage"), message.alias("message")))
    return said.withColumn("answer", F.when(F.col("_said.output").isNotNull(), F.concat_ws("\n\n", *parts))).withColumn("error", error).drop("_said")


def run_questions(items: DataFrame, planner, tool, retrieve, generate, today: Column, rag_prompt) -> DataFrame:
    """One record for each item (id, question, rag_required, information_need): the agent's steps, and, apart from
    them, what the gold information need retrieves (oracle)."""
    done = answered(with_tools(planned(items, planner), tool), retrieve, generate, today, rag_prompt)
    oracle = retrieve(items.where("rag_required").select("id", F.col("information_need").alias("query"))).select(F.col("id").alias("_k"), F.struct("context", "sources").alias("oracle"))
    return done.join(oracle, F.col("id").eqNullSafe(F.col("_k")), "left").drop("_k")


def capability_block(plan: Column, tools: Column, server: str) -> Column:
    """struct<planned, tool, arguments, executed, success, raw_output, error> with the same fields whether or not the server
    was planned."""
    call = F.get(F.filter(F.coalesce(plan["tool_calls"], F.array()), lambda c: c["server"] == server), F.lit(0))
    event = tools[server]
    return F.struct(
        call.isNotNull().alias("planned"), F.coalesce(call["tool"], event["tool"]).alias("tool"), F.coalesce(F.to_json(call["arguments"]), event["arguments"]).alias("arguments"),
        event.isNotNull().alias("executed"), F.when(event.isNotNull(), event["error"].isNull()).alias("success"), event["output"].alias("raw_output"), event["error"].alias("error"),
    )


# --- the judge ----------------------------------------------------------------------------------------------------------------

# What of an item and of a record the judge may see, by the names it sees.
GOLD_FIELDS = ("essential_facts", "evidence_excerpts", "answer_requirements", "weather_requirement", "places_requirement")
EVIDENCE_FIELDS = ("rag_context", "weather_data", "places_data", "raw_tool_outputs")
TEMPLATE_FIELDS = ("question", "gold", "evidence", "final_answer")


def no_answer(answer: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(answer, r"(?U)\s+", " ")) == "", F.lit(True))


def judge_message(rows: DataFrame, template: str) -> Column:
    """The template filled with the question, the allowed gold and evidence fields as JSON, and the final answer. Columns of
    other names never reach it."""
    allowed = lambda names: F.to_json(F.struct(*[F.col(n) for n in names if n in rows.columns]))
    values = {"question": F.col("question"), "gold": allowed(GOLD_FIELDS), "evidence": allowed(EVIDENCE_FIELDS), "final_answer": F.col("final_answer")}
    parts, rest = [], template
    while True:
        at = min((i for i in (rest.find("{" + k + "}") for k in TEMPLATE_FIELDS) if i >= 0), default=-1)
        if at < 0:
            return F.concat(*parts, F.lit(rest))
        name = next(k for k in TEMPLATE_FIELDS if rest.startswith("{" + k + "}", at))
        parts += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]


def judged(rows: DataFrame, judge: Callable[[str], str], template: str, attempts: int = ATTEMPTS, max_chars: int = 600) -> DataFrame:
    """Rows plus judgement struct<error, correctness, faithfulness, relevance>, attempts and automatic.

    A row without an answer scores 0 in all dimensions and is never sent; the others are sent until an output is valid, at most
    `attempts` times, each time only those that aren't settled.
    """
    zero = F.struct(F.lit(None).cast("string").alias("error"), *[F.struct(F.lit(0).alias("score"), F.lit("no answer").alias("reason")).alias(d) for d in E.DIMENSIONS])
    empty = no_answer(F.col("final_answer"))
    done = [rows.where(empty).withColumns({"judgement": zero, "attempts": F.lit(0), "automatic": F.lit(True)})]
    open_ = rows.where(~empty).withColumn("_message", judge_message(rows, template))
    for n in range(1, attempts + 1):
        told = stored(open_.withColumn("_said", called(judge, F.col("_message"))))
        read = E.parse_judgement(F.col("_said.output"), max_chars)
        read = read.withField("error", F.coalesce("_said.error", read["error"]))
        told = told.withColumns({"judgement": read, "attempts": F.lit(n), "automatic": F.lit(False)}).drop("_said")
        settled = F.col("judgement.error").isNull() if n < attempts else F.lit(True)
        done.append(told.where(settled).drop("_message"))
        open_ = told.where(~settled).drop("judgement", "attempts", "automatic")
    return reduce(lambda a, b: a.unionByName(b), done)


def judge_config_problems(config: Column) -> Column:
    """Array of what is wrong with a judge's configuration (JSON)."""
    v = F.try_parse_json(config)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    false = lambda path: F.coalesce(F.get_json_object(config, path) == "false", F.lit(False))
    temperature, policy = F.get_json_object(config, "$.judge.temperature"), get("$.judge.temperature_policy")
    zeros = F.lit(True)
    for d in E.DIMENSIONS:
        zeros = zeros & (F.coalesce(F.get_json_object(config, f"$.no_answer_policy.scores.{d}"), F.lit("")) == "0")
    template = F.coalesce(get("$.user_message_template"), F.lit(""))
    named = F.lit(True)
    for k in TEMPLATE_FIELDS:
        named = named & F.contains(template, F.lit("{" + k + "}"))
    return F.when(v.isNull(), F.array(F.lit("not valid JSON"))).otherwise(
        problems(
            (~F.coalesce(get("$.status").isin("PREPARED", "FROZEN"), F.lit(False)), "status must be PREPARED or FROZEN"),
            (~(((temperature == "0") & policy.isNull()) | (temperature.isNull() & F.coalesce(policy == "not_sent_provider_controlled", F.lit(False)))) | (temperature.isNull() & policy.isNull()), "temperature must be 0, or left to the provider in so many words"),
            (~F.coalesce(F.get_json_object(config, "$.judge.max_attempts") == str(ATTEMPTS), F.lit(False)), f"max_attempts must be {ATTEMPTS}"),
            (~F.coalesce(F.from_json(F.get_json_object(config, "$.dimensions"), "array<string>") == F.array(*[F.lit(d) for d in E.DIMENSIONS]), F.lit(False)), "dimensions differ"),
            (~F.coalesce(F.get_json_object(config, "$.scale") == "[0,1,2]", F.lit(False)), "the scale must be 0, 1, 2"),
            *[(~false(f"$.input_policy.{x}"), f"{x} must be false") for x in ("include_oracle_retrieval", "include_deterministic_metrics", "include_other_questions")],
            (~(false("$.no_answer_policy.call_judge") & zeros), "a missing answer must score zero without a call"),
            (F.get_json_object(config, "$.aggregation").isNull() | F.get_json_object(config, "$.aggregation.composite_score").isNotNull(), "no composite score is allowed"),
            (~named, "the template must name question, gold, evidence and final_answer"),
            (F.coalesce(F.trim(get("$.system_prompt")), F.lit("")) == "", "the system prompt is missing"),
            ((get("$.status") == "FROZEN") & (F.coalesce(get("$.judge.provider"), F.lit("")) == ""), "a frozen configuration needs a provider"),
            ((get("$.status") == "FROZEN") & (F.coalesce(get("$.judge.model"), F.lit("")) == ""), "a frozen configuration needs a model"),
        )
    )


def judge_input_problems(runs: DataFrame) -> DataFrame:
    """(run_id, problem) of runs that may not be judged. runs: run_id, status, valid_run, question_count, record_count,
    digest, expected_digest, judge_model, evaluated_models array."""
    found = problems(
        (~F.coalesce(F.col("status") == "COMPLETED", F.lit(False)), "the run isn't complete"), (~F.coalesce("valid_run", F.lit(False)), "the run isn't valid"),
        (~F.col("question_count").eqNullSafe(F.col("record_count")), "records are missing"), (~F.col("digest").eqNullSafe(F.col("expected_digest")), "the results have changed"),
        (F.coalesce(F.array_contains("evaluated_models", F.col("judge_model")), F.lit(False)), "the judge must be another model than those it judges"),
    )
    return runs.select("run_id", F.explode(found).alias("problem"))
