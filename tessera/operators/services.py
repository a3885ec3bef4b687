"""What tools answer, as joins with lookup tables: places, distances, forecasts, and the prompt that gathers them.

A lookup table stands for a service's answers (name, display_name, country_code, latitude, longitude, importance). Equal
requests are looked up once; only answers are kept, so that a failure is asked again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.places import day_label, haversine_km

MAX_RESULTS = 3
NOT_USED = "(não utilizado)"


def query_key(text: Column) -> Column:
    """Squeezed and lower case; null where nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit(""))


def pending(requests: DataFrame, answered: DataFrame, query: str = "query", country: str = "country_code") -> DataFrame:
    """The distinct keys (key, country) that no earlier success answers."""
    keys = requests.select(query_key(F.col(query)).alias("key"), F.lower(F.col(country)).alias("country")).where(F.col("key").isNotNull()).distinct()
    done = answered.select(F.col("key").alias("_k"), F.col("country").alias("_c"))
    return keys.join(done, (F.col("key") == F.col("_k")) & F.col("country").eqNullSafe(F.col("_c")), "left_anti")


def looked_up(requests: DataFrame, cache: str, service: Callable[[str, str | None], str], pause: float = 0.0, query: str = "query", country: str = "country_code") -> DataFrame:
    """(key, country, answer) of all successes so far, after asking an injected service for the keys that none answers yet.

    Successes are appended to the table at cache, so that a failure is asked again next time. Keys are asked in one partition,
    `pause` seconds apart, as the service allows one request at a time.
    """
    spark = requests.sparkSession
    schema = "key string, country string, answer string"

    def known() -> DataFrame:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, place in pdf.itertuples(index=False):
                try:
                    out.append((key, place, service(key, place)))
                except Exception:  # noqa: BLE001 a failure is asked again
                    continue
                finally:
                    time.sleep(pause)
            yield pd.DataFrame(out, columns=["key", "country", "answer"])

    pending(requests, known(), query, country).coalesce(1).mapInPandas(ask, schema).where("answer IS NOT NULL").write.mode("append").parquet(cache)
    return known()


def search_places(requests: DataFrame, places: DataFrame, key: str, query: str = "query", country: str = "country_code", most: int = MAX_RESULTS) -> DataFrame:
    """(key, rank, name, latitude, longitude, candidates) of the places of the asked name, in the asked country if
    any, by importance, then display name."""
    asked = requests.select(F.col(key).alias("key"), query_key(F.col(query)).alias("_q"), F.lower(F.col(country)).alias("_c"))
    known = places.select(query_key(F.col("name")).alias("_n"), "name", "display_name", F.lower("country_code").alias("_pc"), "latitude", "longitude", "importance")
    found = asked.join(known, (F.col("_q") == F.col("_n")) & (F.col("_c").isNull() | (F.col("_c") == F.col("_pc"))))
    order = Window.partitionBy("key").orderBy(F.desc("importance"), "display_name")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return ranked.where(F.col("rank") <= most).select("key", "rank", "name", "latitude", "longitude", "candidates")


def distances(requests: DataFrame, places: DataFrame, key: str, origin: str = "origin", destination: str = "destination", country: str = "country_code") -> DataFrame:
    """(key, straight_line_distance_km, origin_candidates, destination_candidates) between the best matches; requests of which
    one side isn't found are left out."""
    side = lambda c, p: search_places(requests, places, key, c, country, 1).select("key", F.col("latitude").alias(f"{p}_lat"), F.col("longitude").alias(f"{p}_lon"), F.col("candidates").alias(f"{p}_candidates"))
    both = side(origin, "origin").join(side(destination, "destination"), "key")
    km = haversine_km(F.col("origin_lat"), F.col("origin_lon"), F.col("destination_lat"), F.col("destination_lon"))
    return both.select("key", F.round(km, 3).alias("straight_line_distance_km"), "origin_candidates", "destination_candidates")


def forecasts(requests: DataFrame, places: DataFrame, daily: DataFrame, key: str, query: str = "query", country: str = "country_code", days: str = "days", today: str = "today") -> DataFrame:
    """(key, date, day, code, low, high) of the asked 1 to 7 days at the best match. daily: latitude, longitude, date, code, low, high."""
    best = search_places(requests, places, key, query, country, 1)
    asked = requests.select(F.col(key).alias("key"), F.col(days).alias("_days"), F.col(today).alias("_today")).where(F.col("_days").between(1, 7))
    rows = best.join(asked, "key").join(daily, ["latitude", "longitude"]).where((F.col("date") >= F.col("_today")) & (F.datediff("date", "_today") < F.col("_days")))
    return rows.select("key", "date", day_label(F.col("date"), F.col("_today")).alias("day"), "code", "low", "high")


def final_prompt(today: Column, question: Column, rag: Column, weather: Column, places: Column) -> Column:
    """A block for each capability; those that weren't planned (null) are marked unused."""
    block = lambda title, body: F.concat(F.lit(f"[{title}]\n"), F.coalesce(body, F.lit(NOT_USED)))
    context = F.when(rag == "", F.lit("(nenhum contexto recuperado)")).otherwise(rag)
    parts = [F.concat(F.lit("Data de hoje: "), today, F.lit(".")), block("USER QUESTION", question), block("RAG CONTEXT", context), block("WEATHER DATA", weather), block("PLACES DATA", places), F.lit("Responde apenas com base nos dados acima.")]
    return F.concat_ws("\n\n", *parts)
