"""Agent runs, the judge, the page renderer, the classifier run, and joins that check."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import agent, evaluation, records, router, services, similarity

ITEMS = "id string, question string, rag_required boolean, information_need string"
PLANS = {
    "only rag": {"use_rag": True, "rag_query": "something else", "tool_calls": []},
    "both": {"use_rag": True, "rag_query": "history", "tool_calls": [{"server": "weather", "tool": "get_current_weather", "arguments": {"location": "C"}}, {"server": "places", "tool": "search_place", "arguments": {"query": "p"}}]},
    "tool fails": {"use_rag": True, "rag_query": "x", "tool_calls": [{"server": "weather", "tool": "get_current_weather", "arguments": {"location": "broken"}}]},
    "generator fails": {"use_rag": False, "rag_query": None, "tool_calls": [{"server": "places", "tool": "search_place", "arguments": {"query": "p"}}]},
}


def planner(question):
    if question == "bad plan":
        return "no json"
    if question == "planner down":
        raise RuntimeError("timed out")
    return json.dumps(PLANS[question])


def tool(server, name, arguments):
    if json.loads(arguments).get("location") == "broken":
        raise ValueError("no such place")
    return json.dumps({"attribution": "me"}) if server == "places" else f"{server}/{name}"


def retrieve(asked):
    return asked.select("id", F.concat(F.lit("ctx:"), "query").alias("context"), F.lit(None).cast("string").alias("conflict_note"), F.concat(F.lit("- src:"), "query").alias("sources"))


def generate(prompt):
    if "generator fails" in prompt:
        raise RuntimeError("out of memory")
    return f"<{prompt}>"


def run(spark):
    rows = [(q, q, q == "both", "need") for q in [*PLANS, "bad plan", "planner down"]]
    df = spark.createDataFrame(rows, ITEMS)
    out = agent.run_questions(df, planner, tool, retrieve, generate, F.lit("2026-01-01"), lambda q, c, n: F.concat(F.lit("RAG|"), c, F.lit("|"), q))
    return out, {r["id"]: r for r in out.collect()}


def test_agent_run(spark):
    out, got = run(spark)
    assert len(got) == 6
    one = got["only rag"]
    assert one["answer"] == "<RAG|ctx:only rag|only rag>\n\nFontes:\n- src:only rag" and one["error"] is None and one["tools"] is None and one["oracle"] is None
    both = got["both"]
    assert "ctx:history" in both["prompt"] and "weather/get_current_weather" in both["prompt"] and both["answer"].endswith(f"Fontes:\n- src:history\n\n{agent.WEATHER_SOURCE}\n\nFonte geográfica: me via Places MCP")
    assert both["oracle"]["context"] == "ctx:need"
    failed = got["tool fails"]
    assert failed["error"]["stage"] == "weather" and "no such place" in failed["error"]["message"] and failed["prompt"] is None and failed["answer"] is None and failed["context"] is None
    assert got["generator fails"]["error"].asDict() == {"stage": "generation", "message": "out of memory"}
    assert got["bad plan"]["error"]["stage"] == "planner" and got["bad plan"]["answer"] is None
    assert got["planner down"]["error"].asDict() == {"stage": "planner", "message": "timed out"}
    blocks = {r["id"]: r for r in out.select("id", agent.capability_block(F.col("plan"), F.col("tools"), "weather").alias("w")).collect()}
    assert blocks["only rag"]["w"].asDict() == {"planned": False, "tool": None, "arguments": None, "executed": False, "success": None, "raw_output": None, "error": None}
    assert blocks["tool fails"]["w"]["success"] is False and blocks["both"]["w"]["success"] is True and blocks["both"]["w"]["raw_output"] == "weather/get_current_weather"


def verdict(n):
    return json.dumps({d: {"score": n, "reason": "because"} for d in evaluation.DIMENSIONS})


def test_judge_sees_only_what_it_may_and_retries_once(spark, tmp_path):
    log = tmp_path / "seen"

    def judge(message):
        with log.open("a") as f:
            f.write(message + "\x00")
        n = log.read_text().count(message)
        if "never valid" in message:
            return "{}"
        return "oops" if "second time" in message and n == 1 else verdict(2)

    rows = [("a", "q a", "plain", "fact", "SECRET"), ("b", "q b", "second time", "fact", "SECRET"), ("c", "q c", "never valid", "fact", "SECRET"), ("d", "q d", "  ", "fact", "SECRET"), ("e", "q e", None, "fact", "SECRET")]
    df = spark.createDataFrame(rows, "id string, question string, final_answer string, essential_facts string, expected_tool string").coalesce(1)
    out = {r["id"]: r for r in agent.judged(df, judge, "Q={question} G={gold} E={evidence} A={final_answer}.").collect()}
    assert [(out[x]["attempts"], out[x]["automatic"]) for x in "abcde"] == [(1, False), (2, False), (2, False), (0, True), (0, True)]
    assert out["b"]["judgement"]["relevance"]["score"] == 2 and out["c"]["judgement"]["error"] and out["d"]["judgement"]["correctness"]["score"] == 0 and out["e"]["judgement"]["error"] is None
    seen = log.read_text().split("\x00")[:-1]
    assert len(seen) == 5 and not any("SECRET" in m or "q d" in m or "q e" in m for m in seen)
    assert seen[0] == 'Q=q a G={"essential_facts":"fact"} E={} A=plain.'


CONFIG = {
    "status": "PREPARED", "judge": {"temperature": 0, "max_attempts": 2, "provider": "p", "model": "m"}, "dimensions": list(evaluation.DIMENSIONS), "scale": [0, 1, 2],
    "input_policy": {"include_oracle_retrieval": False, "include_deterministic_metrics": False, "include_other_questions": False},
    "no_answer_policy": {"call_judge": False, "scores": dict.fromkeys(evaluation.DIMENSIONS, 0)}, "aggregation": {"composite_score": None},
    "user_message_template": "{question}{gold}{evidence}{final_answer}", "system_prompt": "judge",
}


def test_judge_gates(spark):
    def changed(path, value):
        out = json.loads(json.dumps(CONFIG))
        at = out
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        return out

    cases = [
        (CONFIG, 0), (changed(["status"], "DRAFT"), 1), (changed(["judge", "temperature"], 0.5), 1), (changed(["judge", "max_attempts"], 3), 1), (changed(["dimensions"], ["relevance"]), 1), (changed(["scale"], [0, 1]), 1),
        (changed(["input_policy", "include_oracle_retrieval"], True), 1), (changed(["no_answer_policy", "call_judge"], True), 1), (changed(["no_answer_policy", "scores", "relevance"], 1), 1),
        (changed(["aggregation", "composite_score"], 1), 1), (changed(["user_message_template"], "{question}"), 1), (changed(["system_prompt"], " "), 1), ("x", 1),
        (changed(["judge"], {"temperature": None, "temperature_policy": "not_sent_provider_controlled", "max_attempts": 2}), 0), (changed(["judge"], {"temperature": None, "max_attempts": 2}), 1),
        ({**changed(["judge", "model"], None), "status": "FROZEN"}, 1),
    ]
    df = spark.createDataFrame([(i, json.dumps(c) if c != "x" else c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r["i"]: r["p"] for r in df.select("i", agent.judge_config_problems(F.col("c")).alias("p")).collect()}
    assert [len(got[i]) for i in range(len(cases))] == [n for _, n in cases], got
    runs = [("ok", "COMPLETED", True, 3, 3, "d", "d", "j", ["a"]), ("bad", "ABORTED", False, 3, 2, "d", "e", "a", ["a", "b"])]
    df = spark.createDataFrame(runs, "run_id string, status string, valid_run boolean, question_count int, record_count int, digest string, expected_digest string, judge_model string, evaluated_models array<string>")
    assert {r["run_id"] for r in agent.judge_input_problems(df).collect()} == {"bad"} and agent.judge_input_problems(df).count() == 5


def test_join_that_checks(spark):
    left = spark.createDataFrame([("Q1", "one", 1), ("Q2", "two", 2)], "id string, question string, n int")
    right = spark.createDataFrame([("Q2", "two", "b"), ("Q1", "one", "a"), ("Q3", "three", "c")], "id string, question string, answer string")
    assert sorted(map(tuple, evaluation.joined_alike(left, right, "id", "question").collect())) == [("Q1", "one", 1, "a"), ("Q2", "two", 2, "b")]
    for other in (right.where("id <> 'Q2'"), right.withColumn("question", F.upper("question"))):
        with pytest.raises(Exception, match="no row for Q2|question differs"):
            evaluation.joined_alike(left, other, "id", "question").collect()


def test_page_body(spark):
    lines = [
        "12 Coimbra, Património Mundial", "3. PÁTIO DAS", "ESCOLAS", "Uma linha que se pro-", "longa e continua", "aqui.", "", "Outro parágrafo.", "Coordenadas : 40.2, -8.4", "Secção fixa",
        "- um ponto", "2) dois", "TÍTULO GERAL", "fim. fala-", "se bem", "Coimbra, Património Mundial 13",
    ]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)] + [("q", 0, "só texto")], "page string, pos int, line string")
    got = {r["page"]: r for r in records.page_body(df, "page", "pos", "line", ["Secção fixa"]).collect()}
    assert got["p"]["body"].split("\n\n") == [
        "## 3. PÁTIO DAS ESCOLAS", "Uma linha que se prolonga e continua aqui.", "Outro parágrafo.", "**Coordenadas:** 40.2, -8.4", "## Secção fixa", "- um ponto", "2) dois", "### TÍTULO GERAL", "fim. fala-se bem",
    ]
    assert got["p"]["headings"] == 3 and got["q"].asDict() == {"page": "q", "body": "só texto", "headings": 0}


def test_classifier_run(spark):
    rows = [(i, ("onde fica o museu antigo " if i % 2 else "és mesmo burro e feio ") + f"palavra{i % 7}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "key int, text string, label int")
    chosen, model, told, sizes = router.train_router(df, "text", "label", "key")
    assert chosen in ("A", "B") and {r["experiment"] for r in told.collect()} == {"A", "B"}
    assert {tuple(r) for r in sizes.collect()} == {(0, 28, 12), (1, 28, 12)}
    assert model.transform(router.prepared(df, "text")).where("prediction <> label").count() == 0


def test_comments_are_not_shared_text(spark):
    words = "um dois três quatro cinco seis"
    docs = spark.createDataFrame([(1, words)], "id int, text string")
    corpus = spark.createDataFrame([("c", f"<!-- {words} -->"), ("d", f"x <!-- y\n --> {words}")], "id string, text string")
    assert [tuple(r) for r in similarity.best_overlap(docs, "id", "text", corpus, "id", "text").collect()] == [(1, "d", 1.0)]


def test_cache_keeps_successes_only(spark, tmp_path):
    asked = tmp_path / "asked"

    def service(key, country):
        with asked.open("a") as f:
            f.write(f"{key},{country}\n")
        if key == "down":
            raise OSError("503")
        return f"at {key}"

    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(" Sé  Velha", "PT"), ("sé velha", "pt"), ("down", None), (None, "pt")], "query string, country_code string")
    for n in (2, 1):
        got = services.looked_up(df, path, service)
        assert [tuple(r) for r in got.collect()] == [("sé velha", "pt", "at sé velha")]
        assert len(asked.read_text().splitlines()) == n
        asked.write_text("")


def test_planner_check_and_corpus_counts(spark):
    df = spark.createDataFrame([("c", "rag", "rag"), ("c", "rag", None), ("d", "weather", "rag+weather")], "category string, expected string, predicted string")
    assert {tuple(r) for r in evaluation.planner_check(df).collect()} == {("c", 1, 2), ("d", 0, 1), (None, 1, 3)}
    chunks = spark.createDataFrame([("a::c1", "a", None, "n", 5), ("a::c2", "a", "x", "", 2000), ("b::c1", "b", "x", None, 500)], "chunk_id string, document_id string, primary_category string, conflict_notes string, body_chars int")
    assert {tuple(r) for r in records.corpus_counts(chunks).collect()} == {("document_id", "a", 2), ("document_id", "b", 1), ("primary_category", "None", 1), ("primary_category", "x", 2), ("conflict_notes", "with", 1)}
    assert {tuple(r) for r in records.small_and_large(chunks).collect()} == {("a::c1", 5, "small"), ("a::c2", 2000, "large")}


def test_queries_of_mixed_widths(spark):
    from tessera.operators import retrieval

    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1, 0.0]), (4, [0.1, 1.0]), (5, []), (6, None), (7, [0.0, 0.0])], "id int, v array<double>")
    got = {r["query_id"]: r["key"] for r in retrieval.top_k(df, "id", "v", df, "id", "v", 2).where("rank = 2").collect()}
    assert got == {1: 3, 3: 1, 2: 4, 4: 2}


def test_model_availability_and_prompts(spark):
    from tessera.operators import retrieval

    assert retrieval.available(lambda p: "ok") is None and retrieval.available(lambda p: " ") == "empty answer" and retrieval.available(lambda p: 1 / 0) == "division by zero"
    row = spark.range(1).select(retrieval.older_messages(F.lit("s"), F.lit("q?"), F.lit("c")).alias("a"), retrieval.bare_messages(F.lit("s"), F.lit("q?")).alias("b")).first()
    assert tuple(row["a"]) == ("s\n\nCONTEXTO:\n\nc", "q?") and tuple(row["b"]) == ("s", "q?")
