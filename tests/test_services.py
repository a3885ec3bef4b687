from datetime import date

from pyspark.sql import functions as F

from tessera.functions.text import block
from tessera.operators import services

PLACES = "name string, display_name string, country_code string, latitude double, longitude double, importance double"
ROWS = [("Porto", "Porto, PT", "pt", 41.1, -8.6, 0.9), ("porto", "Porto, IT", "it", 42.3, 8.7, 0.2), ("Porto", "Porto, BR", "br", 1.0, 1.0, 0.1), ("Porto", "Porto, ES", "es", 2.0, 2.0, 0.1), ("Faro", "Faro, PT", "pt", 37.0, -7.9, 0.5)]


def test_search(spark):
    places = spark.createDataFrame(ROWS, PLACES)
    asked = spark.createDataFrame([(1, "  PORTO ", None), (2, "porto", "IT"), (3, " ", None), (4, None, None), (5, "nowhere", None)], "id int, query string, country_code string")
    got = sorted(map(tuple, services.search_places(asked, places, "id").select("key", "rank", "latitude", "candidates").collect()))
    assert got == [(1, 1, 41.1, 4), (1, 2, 42.3, 4), (1, 3, 1.0, 4), (2, 1, 42.3, 1)]


def test_only_new_keys_are_pending(spark):
    asked = spark.createDataFrame([("Porto", None), (" porto ", None), ("Faro", "PT"), ("", None)], "query string, country_code string")
    done = spark.createDataFrame([("porto", None)], "key string, country string")
    assert [tuple(r) for r in services.pending(asked, done).collect()] == [("faro", "pt")]


def test_distance(spark):
    places = spark.createDataFrame(ROWS, PLACES)
    asked = spark.createDataFrame([(1, "porto", "faro", None), (2, "porto", "nowhere", None)], "id int, origin string, destination string, country_code string")
    rows = services.distances(asked, places, "id").collect()
    assert len(rows) == 1 and (rows[0]["origin_candidates"], rows[0]["destination_candidates"]) == (4, 1) and 455 < rows[0]["straight_line_distance_km"] < 462


def test_forecast(spark):
    places = spark.createDataFrame(ROWS, PLACES)
    daily = spark.createDataFrame([(37.0, -7.9, date(2026, 1, d), 0, 1.0, 2.0) for d in range(1, 10)], "latitude double, longitude double, date date, code int, low double, high double")
    asked = spark.createDataFrame([(1, "faro", None, 2, date(2026, 1, 5)), (2, "faro", None, 8, date(2026, 1, 5))], "id int, query string, country_code string, days int, today date")
    got = services.forecasts(asked, places, daily, "id").orderBy("date").collect()
    assert [(r["key"], r["day"]) for r in got] == [(1, "segunda-feira (hoje)"), (1, "terça-feira (amanhã)")]


def test_prompt_blocks_come_back(spark):
    df = spark.createDataFrame([("q", "", None)], "q string, rag string, w string")
    prompt = services.final_prompt(F.lit("hoje"), F.col("q"), F.col("rag"), F.col("w"), F.lit("{}"))
    r = df.select(block(prompt, "USER QUESTION"), block(prompt, "RAG CONTEXT"), block(prompt, "WEATHER DATA"), block(prompt, "PLACES DATA")).first()
    assert tuple(r)[:3] == ("q", "(nenhum contexto recuperado)", None)
