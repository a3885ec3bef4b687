import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import calls
from tessera.sources import store


def transport(request):
    if request == "late":
        raise TimeoutError("15 s")
    if request == "gone":
        raise ConnectionResetError("reset")
    if request == "odd":
        raise KeyError("k")
    if request == "stuck":
        time.sleep(3)
    return {"404": calls.Response(404, "no"), "blank": calls.Response(200, "  "), "text": "not json", "good": calls.Response(200, '{"a": 1}')}.get(request, '"x"')


def test_each_failure_has_its_type(spark):
    asked = ["good", "late", "gone", "odd", "404", "blank", "text", "stuck", None, "plain"]
    df = spark.createDataFrame([(i, r, "old") for i, r in enumerate(asked)], "id int, request string, Result string").coalesce(1)
    got = calls.call_service(df, "request", transport, timeout=1.0, workers=3).orderBy("id").collect()
    assert [r["request"] for r in got] == asked and len(got[0]) == 3
    assert [r["result"]["failure"] if r["result"] else "unsent" for r in got] == [None, "timeout", "connection", "error", "status", "empty", "not_json", "timeout", "unsent", None]
    assert got[0]["result"]["body"] == '{"a": 1}' and got[4]["result"]["message"] == "status 404"
    counts = calls.call_service(df, "request", transport, timeout=1.0).groupBy(calls.failures(F.col("result")).alias("f")).count()
    assert dict(map(tuple, counts.collect()))["ok"] == 2


def test_no_more_calls_at_a_time_than_workers(spark, tmp_path):
    def slow(request):
        name = tmp_path / f"{request}-{time.time_ns()}"
        name.touch()
        running = len(list(tmp_path.iterdir()))
        time.sleep(0.05)
        name.unlink()
        return str(running)

    df = spark.range(24).select(F.col("id").cast("string").alias("r")).coalesce(1)
    most = calls.call_service(df, "r", slow, workers=3).select(F.max(F.col("result.body").cast("int"))).first()[0]
    assert most <= 3


def test_each_call_is_traced_once(spark):
    def plan(x):
        if x == "bad":
            raise ValueError("no plan")
        return {"q": x}

    def find(p):
        if p["q"] == "none":
            raise LookupError("none found")
        return [p["q"], 1]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "none"), (4, None)], "id int, text string")
    rows, events = calls.traced(df, "id", "text", {"plan": plan, "find": find})
    assert {tuple(r) for r in rows.collect()} == {(1, '["a", 1]', None), (2, None, "plan"), (3, None, "find"), (4, "[null, 1]", None)}
    got = sorted(map(tuple, events.collect()))
    assert got == [
        (1, 1, "plan", '"a"', '{"q": "a"}', None), (1, 2, "find", '{"q": "a"}', '["a", 1]', None), (2, 1, "plan", '"bad"', None, "ValueError: no plan"),
        (3, 1, "plan", '"none"', '{"q": "none"}', None), (3, 2, "find", '{"q": "none"}', None, "LookupError: none found"), (4, 1, "plan", None, '{"q": null}', None), (4, 2, "find", '{"q": null}', "[null, 1]", None),
    ]
    assert json.loads(calls.as_json({"a": {1, 2} - {2}})) == {"a": "{1}"}


class Clock:
    """Seconds that pass only by sleeping."""

    def __init__(self):
        self.now = 100.0

    def __call__(self):
        self.now += 0.25  # a call takes a little
        return self.now

    def sleep(self, s):
        self.now += s


def page(url):
    if url.endswith("3"):
        raise ConnectionError("down")
    return f"<p>{url}</p>"


def test_no_host_above_its_rate_and_no_page_twice(spark):
    rows = [(f"https://{h}/{i}", h) for h in ("a", "b", None) for i in range(12 if h == "a" else 4)]
    df = spark.createDataFrame(rows + rows[:3], "url string, host string")
    path, clock = store.scratch(spark), Clock()
    first = calls.fetch_pending(df.where("url not like '%/2'"), path, page, clock=clock, sleep=clock.sleep, interval=2.0).collect()
    assert len(first) == len({r["url"] for r in first}) == 17
    for h in "ab":
        times = sorted(r["fetched"] for r in first if r["url"].startswith(f"https://{h}/"))
        assert all(b - a >= 2.0 for a, b in zip(times, times[1:], strict=False))
    again = {r["url"]: tuple(r) for r in calls.fetch_pending(df, path, lambda u: "new", clock=clock, sleep=clock.sleep).collect()}
    assert len(again) == 20 and all(again[r["url"]] == tuple(r) for r in first)
    assert {u for u, r in again.items() if r[2] == "new"} == {f"https://{h}/2" for h in ("a", "b", None)}
    assert [r["slot"] for r in calls.schedule(df, "url", "host", 1.5).where("host = 'a'").orderBy("slot").collect()] == list(range(12))


def test_a_stopped_run_ends_as_one_that_was_not(spark):
    items = spark.range(200).select("id", F.concat(F.lit("q"), "id").alias("q"))
    answer = lambda df: df.select("id", F.upper("q").alias("said"))
    whole, halves = store.scratch(spark), store.scratch(spark)
    calls.resume_run(items, "id", whole, answer)
    part = calls.resume_run(items, "id", halves, answer, stop_after=3)
    assert 0 < part.count() < 200
    asked = []
    done = calls.resume_run(items, "id", halves, lambda df: asked.append(df.count()) or answer(df), protected={"items": items})
    assert sum(asked) == 200 - part.count()
    assert calls.table_digest(done) == calls.table_digest(spark.read.parquet(whole)) and done.count() == 200
    state = iter(["a", "b"])
    moving = type("T", (), {"agg": None})
    with pytest.raises(ValueError, match="changed during the run: t"):
        original, calls.table_digest = calls.table_digest, lambda t: next(state)
        try:
            calls.resume_run(items, "id", store.scratch(spark), answer, protected={"t": moving})
        finally:
            calls.table_digest = original
