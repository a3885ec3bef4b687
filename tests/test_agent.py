import pytest
from pyspark.sql import functions as F

from tessera.operators import dialogue, evaluation, retrieval, router


def test_top_k(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = retrieval.top_k(df.where("id in (0, 3)"), "id", "v", df, "id", "v", 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["key"]) for r in got] == [(0, 1, 0), (0, 2, 1), (0, 3, 2)]
    assert retrieval.top_k(df.where("id < 0"), "id", "v", df, "id", "v").count() == 0
    both = retrieval.top_k(df.where("id in (0, 2)"), "id", "v", df, "id", "v", 1).collect()
    assert sorted((r["query_id"], r["key"]) for r in both) == [(0, 0), (2, 2)]


def test_context_notes_and_sources(spark):
    rows = [(1, 1, "A", "a", "S", "p. 1, 2", True, "x", "n"), (1, 2, "B", "b", "S", "u", False, "y", "n"), (1, 3, "A", "a", "S", "p. 1, 2", True, "z", None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, title string, document_id string, section string, place string, is_pdf boolean, text string, conflict_notes string")
    r = retrieval.context(df).first()
    assert r["context"].startswith("[Fonte 1]\nDocumento: A (a)\nSecção: S\nPáginas: p. 1, 2\n\nx\n\n[Fonte 2]") and r["conflict_note"] == "- Fonte 1: n"
    assert r["sources"] == "- A [a] — S — páginas 1, 2\n- B [b] — S — u"


def test_models_are_injected(spark):
    df = spark.createDataFrame([("ok",), ("boom",)], "p string")

    def model(p):
        if p == "boom":
            raise RuntimeError("down")
        return p + "!"

    assert sorted(map(tuple, retrieval.generate(df, "p", "a", model).collect()), key=str) == [("boom", None, "down"), ("ok", "ok!", None)]
    vectors = retrieval.embed(df, "p", "v", lambda texts: [[float(len(t)), 0.0] for t in texts]).collect()
    assert all(r["v"] == [1.0, 0.0] for r in vectors)


def test_store_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(ValueError):
        retrieval.build_store(df, str(tmp_path / "s"), "id")
    assert retrieval.build_store(df.distinct(), str(tmp_path / "t"), "id") == 1
    with pytest.raises(FileNotFoundError):
        retrieval.open_store(spark, str(tmp_path / "none"))


def test_rules(spark):
    rules = (dialogue.Rule(r"eu (?:sou|estou) (.*)", ("Porque %1?", "És mesmo %1?")), dialogue.Rule(r".*", ("Continua.",)))
    df = spark.createDataFrame([("Eu sou o teu amigo",), ("olá",), (None,)], "t string")
    got = [r[0] for r in df.select(dialogue.respond(F.col("t"), F.col("t"), rules, {"teu": "meu", "meu": "teu"})["response"]).collect()]
    assert got[0] in ("Porque o meu amigo?", "És mesmo o meu amigo?") and got[1] == "Continua." and got[2] is None


GUIDE = dialogue.Guide(
    entities=((r"\bmuseu a\b", "Museu A", "museus"), (r"\bmuseu b\b", "Museu B", "museus"), (r"\bjardim\b", "Jardim", "jardins")),
    categories=((r"museus?", "museus"), (r"jardins?", "jardins")),
    answer=lambda t: "Tenho o Museu A. Queres saber mais sobre Museu A?" if t.strip().lower() == "museus" else f"[{t}]",
)
TURNS = [
    ("museus", "Tenho o Museu A. Queres saber mais sobre Museu A?", "Museu A", "about"), ("sim", "[about Museu A]", "Museu A", None), ("sim", "[sim]", "Museu A", None),
    ("onde fica ele?", "[where Museu A]", "Museu A", None), ("há outro museu?", "Museu B. Queres saber mais sobre Museu B?", "Museu B", "about"), ("não", "Sobre que categoria queres saber mais?", "Museu B", None),
    ("jardim", "[jardim]", "Jardim", None), ("outro", "Sobre que categoria queres saber mais?", "Jardim", None), ("museu a e museu b", "[museu a e museu b]", None, None),
]


def test_guide():
    memory = dialogue.Memory()
    for said, reply, place, pending in TURNS:
        assert dialogue.turn(GUIDE, memory, said) == reply, said
        assert (memory.place, memory.pending) == (place, pending), said


def test_what_a_yes_means():
    """Each pending action, with and without what it is about, and what withdraws it."""
    yes = "sim"
    (name, category) = GUIDE.entities[0][1:]
    for pending, memory, want in [
        ("about", dialogue.Memory(name, category, "about"), GUIDE.answer(f"about {name}")),
        ("where", dialogue.Memory(name, category, "where"), GUIDE.answer(f"where {name}")),
        ("about", dialogue.Memory(None, category, "about"), GUIDE.fallback),
        ("another", dialogue.Memory(name, None, "another"), GUIDE.fallback),
        ("unheard of", dialogue.Memory(name, category, "unheard of"), GUIDE.fallback),
    ]:
        assert dialogue.intent(GUIDE, memory, yes) == "confirm"
        assert dialogue.turn(GUIDE, memory, yes) == want and memory.pending is None, pending
    others = list(dict.fromkeys(n for _, n, c in GUIDE.entities if c == category and n != name))
    memory = dialogue.Memory(name, category, "another")
    reply = dialogue.turn(GUIDE, memory, yes)
    assert all(n in reply for n in others) if others else reply == GUIDE.fallback
    assert (memory.place, memory.pending) == ((others[0], "about") if len(others) == 1 else (name, None))
    memory = dialogue.Memory(name, category, "where")
    assert dialogue.turn(GUIDE, memory, "não") == GUIDE.fallback and memory == dialogue.Memory(name, category)
    assert dialogue.intent(GUIDE, dialogue.Memory(), yes) == "plain"


def test_guide_in_batch_and_as_a_stream(spark, tmp_path):
    from tessera.streaming.conversations import converse_stream, event_rates, sessions

    rows = [(c, i, t[0]) for c in (1, 2) for i, t in enumerate(TURNS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    batch = sorted(map(tuple, dialogue.converse(df, GUIDE).collect()), key=str)
    assert [r[2] for r in batch if r[0] == 1] == [t[1] for t in TURNS]
    src = str(tmp_path / "in")
    df.where("turn < 4").coalesce(1).write.parquet(src)
    df.where("turn >= 4").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(src)
    q = converse_stream(stream, GUIDE, None).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("told").collect()), key=str) == batch
    events = spark.sql("SELECT timestamp'2026-01-01 00:01:00' AS ts, 1L AS user_id, 'x' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2026-01-01 00:04:00', 1L, 'x', 3.0D UNION ALL SELECT timestamp'2026-01-01 02:00:00', 1L, 'x', 1.0D")
    assert sorted(r["n"] for r in event_rates(events).collect()) == [1, 2] and sorted(r["n"] for r in sessions(events).collect()) == [1, 2]


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    got = router.stratified_split(df, "label", "id").cache()
    assert {(r["label"], r["is_test"]): r["count"] for r in got.groupBy("label", "is_test").count().collect()} == {("a", True): 100, ("a", False): 234, ("b", True): 200, ("b", False): 466}
    again = {r["id"] for r in router.stratified_split(df.repartition(7), "label", "id").where("is_test").collect()}
    assert again == {r["id"] for r in got.where("is_test").collect()}


def test_router_learns_and_is_saved(spark, tmp_path):
    rows = [(i, f"quero visitar o museu {i}" if i % 2 else f"tu és muito chato {i}", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    for build in (router.tfidf_logistic, router.counts_bayes):
        model = build().fit(router.prepared(df.where("id < 80"), "text", F.col("y")))
        router.save(model, str(tmp_path / build.__name__))
        routed = router.route(router.load(str(tmp_path / build.__name__)), df.where("id >= 80"), "text").collect()
        assert all((r["route"] == "rag") == (r["y"] == 1) == (r["probability"] >= 0.45) for r in routed)


def test_model_selection():
    pick = lambda fa, ga, fb, gb: router.select_model({"macro_f1": fa, "gap": ga}, {"macro_f1": fb, "gap": gb}, 60)
    assert (pick(0.9, 0.1, 0.95, 0.2), pick(0.95, 0.1, 0.9, 0), pick(0.95, 0.1, 0.951, 0.05), pick(0.95, 0.1, 0.95, 0.1)) == ("B", "A", "B", "A")


@pytest.mark.parametrize(("text", "error"), [
    ('{"use_rag":true,"rag_query":null,"tool_calls":[]}', None),
    ('{"use_rag":"true","rag_query":null,"tool_calls":[]}', "use_rag must be true or false"),
    ("[1]", "the plan must be a JSON object"), ("{", "not valid JSON"), (None, "not valid JSON"),
    ('{"use_rag":true}', "tool_calls must be a list"),
    ('{"use_rag":false,"tool_calls":[{"server":"x","tool":"y","arguments":{}}]}', "unknown server"),
    ('{"use_rag":false,"tool_calls":[{"server":"weather","tool":"search_place","arguments":{}}]}', "unknown tool for the server"),
    ('{"use_rag":false,"tool_calls":[{"server":"places","tool":"search_place","arguments":{"query":" "}}]}', "search_place: query must be a non-empty string"),
    ('{"use_rag":false,"tool_calls":[{"server":"places","tool":"search_place","arguments":{"query":"a","zoom":1}}]}', "search_place: unexpected arguments zoom"),
    ('{"use_rag":false,"tool_calls":[{"server":"places","tool":"search_place","arguments":{"query":"a","country_code":"PRT"}}]}', "country_code must be null or a two-letter code"),
    ('{"use_rag":false,"tool_calls":[{"server":"weather","tool":"get_weather_forecast","arguments":{"location":"a","days":8}}]}', "get_weather_forecast: days must be an integer between 1 and 7"),
    ('{"use_rag":false,"tool_calls":[{"server":"weather","tool":"get_weather_forecast","arguments":{"location":"a","days":true}}]}', "get_weather_forecast: days must be an integer between 1 and 7"),
    ('{"use_rag":false,"tool_calls":[{"server":"weather","tool":"get_current_weather","arguments":{"location":"a","days":null}}]}', None),
])
def test_plans(spark, text, error):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(evaluation.parse_plan(F.col("t"))["error"]).first()[0] == error


def test_plan_retry(spark):
    good = '{"use_rag":false,"rag_query":"x","tool_calls":[{"server":"places","tool":"search_place","arguments":{"query":" a ","country_code":"PT"}}]}'
    df = spark.createDataFrame([("{", good), (good, None), ("{", "{")], "a string, b string")
    rows = [r[0] for r in df.select(evaluation.plan_with_retry(F.col("a"), F.col("b"))).collect()]
    assert [r["error"] for r in rows] == [None, None, "not valid JSON"]
    assert rows[0]["rag_query"] is None and rows[0]["tool_calls"][0]["arguments"] == {"query": "a", "country_code": "pt"}


def test_judgements(spark):
    ok = '{"correctness":{"score":2,"reason":" r "},"faithfulness":{"score":0,"reason":"r"},"relevance":{"score":1,"reason":"r"}}'
    bad = [ok.replace('"score":2', s) for s in ('"score":3', '"score":1.5', '"score":true', '"score":null', '"score":"2"')] + [ok.replace('" r "', '""'), ok[:-1], "{}"]
    df = spark.createDataFrame([(x,) for x in [ok, *bad]], "t string")
    rows = [r[0] for r in df.select(evaluation.parse_judgement(F.col("t"))).collect()]
    assert rows[0]["error"] is None and rows[0]["correctness"]["reason"] == "r" and all(r["error"] for r in rows[1:])


def test_retrieval_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "b", "a"]), (["a", "a"], ["a"]), (["a"], None), (["a"], [])], "g array<string>, f array<string>")
    got = [tuple(r[0]) for r in df.select(evaluation.retrieval_scores(F.col("g"), F.col("f"))).collect()]
    assert got == [(1, 1.0, 0.5, 2), (1, 1.0, 1.0, 1), (0, 0.0, 0.0, None), (0, 0.0, 0.0, None)]


def test_run_and_item_checks(spark):
    items = spark.createDataFrame([("a", 1, "g"), ("b", 2, "g"), ("c", 3, "g")], "id string, position int, gold string")
    records = spark.createDataFrame([("a", 1, "g"), ("b", 1, "g"), ("d", 4, "g")], "id string, position int, gold string")
    assert {tuple(r) for r in evaluation.run_problems(items, records).collect()} == {("b", "out of order"), ("c", "no record"), ("d", "record without an item")}
    rows = [("1", "x", True, False, False, None, None, ["c"]), ("1", "x", False, True, False, "bad", None, None)]
    df = spark.createDataFrame(rows, "id string, category string, rag boolean, weather boolean, places boolean, expected_weather string, expected_places string, gold_chunks array<string>")
    found = {r["problem"] for r in evaluation.item_problems(df, ("x",), 2, 1).collect()}
    assert found == {"duplicate id", "weather: expected tool missing or unknown", "capability has 0 items"}


def test_execution_failure_does_not_change_capabilities(spark):
    df = spark.sql("SELECT true AS ok, true AS rag, array(named_struct('server', 'weather', 'tool', 't')) AS calls")
    pred = evaluation.predicted_capabilities
    assert tuple(df.select(pred(F.col("ok"), F.col("rag"), F.col("calls"))).first()[0]) == (True, True, False)
    assert tuple(df.select(pred(F.lit(False), F.col("rag"), F.col("calls"))).first()[0]) == (False, False, False)


def test_top_k_takes_more_queries_than_a_block(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(25)], "id long, v array<double>")
    whole = sorted(map(tuple, retrieval.top_k(df, "id", "v", df, "id", "v", 3).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    monkeypatch.setattr(retrieval, "BROADCAST_MB", -1)  # queries are dealt out, not broadcast
    blocks = sorted(map(tuple, retrieval.top_k(df, "id", "v", df, "id", "v", 3).collect()))
    assert [r[:3] for r in blocks] == [r[:3] for r in whole] and len(blocks) == 75


def test_ascii_words(spark):
    """A word ends before a letter that isn't ASCII where the caller says so, and . stops at line feeds alone."""
    df = spark.createDataFrame([(0, "Etè x"), (1, "inörd"), (2, "a\rthe b"), (3, "\u00a0in %2 the ox")], "i int, t string").orderBy("i")
    rules = (dialogue.Rule(r"(.*)\bthe (\w+)", ("%1 - %2",)), dialogue.Rule(r"(?:in|et)\b.*", ("go",)), dialogue.Rule(r".*", ("more",)))
    run = lambda **k: [r[0] for r in df.select(dialogue.respond(F.col("t"), F.col("t"), rules, **k)["response"]).collect()]
    assert run(ascii_words=True) == ["go", "go", "a\r - b", "in %2  - ox"]
    assert run()[2:] == ["a\r - b", "in %2  - ox"]
    places = ((r"\bin\b", "in", "p"),)
    tags = [(r[0], r[1]) for r in df.select(dialogue.tags(F.col("t"), places, ascii_words=True)["name"], dialogue.category(F.col("t"), ((r"\bin\b", "p"),), ascii_words=True)).collect()]
    assert tags == [([], None), (["in"], "p"), ([], None), (["in"], "p")]
