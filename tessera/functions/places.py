"""Distances, weather codes, day labels and the checks of service answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088

# WMO weather interpretation codes.
WEATHER = {
    0: "Céu limpo", 1: "Maioritariamente limpo", 2: "Parcialmente nublado", 3: "Nublado",
    45: "Nevoeiro", 48: "Nevoeiro com deposição de geada",
    51: "Chuvisco fraco", 53: "Chuvisco moderado", 55: "Chuvisco intenso", 56: "Chuvisco gelado fraco", 57: "Chuvisco gelado intenso",
    61: "Chuva fraca", 63: "Chuva moderada", 65: "Chuva forte", 66: "Chuva gelada fraca", 67: "Chuva gelada forte",
    71: "Queda de neve fraca", 73: "Queda de neve moderada", 75: "Queda de neve forte", 77: "Grãos de neve",
    80: "Aguaceiros fracos", 81: "Aguaceiros moderados", 82: "Aguaceiros violentos", 85: "Aguaceiros de neve fracos", 86: "Aguaceiros de neve fortes",
    95: "Trovoada", 96: "Trovoada com granizo fraco", 99: "Trovoada com granizo forte",
}
# Names of the days.
WEEKDAYS = ("segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_KM)


def weather(code: Column, strict: bool = True) -> Column:
    """The description of a code; an unknown code fails, or is null if not strict."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in WEATHER.items() for x in pair]), code.cast("int"))
    if not strict:
        return known
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown weather code: "), F.coalesce(code.cast("string"), F.lit("null")))).cast("string"))


def day_label(day: Column, today: Column) -> Column:
    """The weekday, and whether the day is today or tomorrow."""
    name = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(day) + 1)
    return F.concat(name, F.when(F.datediff(day, today) == 0, F.lit(" (hoje)")).when(F.datediff(day, today) == 1, F.lit(" (amanhã)")).otherwise(F.lit("")))


def coordinate(raw: Column, limit: float) -> Column:
    """struct<value, error> of a coordinate given as text."""
    value = raw.try_cast("double")
    wrong = F.when(raw.isNull(), F.lit("missing")).when(value.isNull(), F.lit("not a number")).when(F.isnan(value) | (F.abs(value) > limit), F.lit("out of range"))
    return F.struct(F.when(wrong.isNull(), value).alias("value"), wrong.alias("error"))


def country_code(raw: Column) -> Column:
    """struct<value, error>: null, or two ASCII letters in lower case."""
    wrong = F.when(raw.isNotNull() & ~raw.rlike(r"^[A-Za-z]{2}$"), F.lit("two letters are expected"))
    return F.struct(F.when(wrong.isNull(), F.lower(raw)).alias("value"), wrong.alias("error"))


def forecast_rows(daily: Column, fields: list[str]) -> Column:
    """The service's parallel arrays as array<struct>; null unless all have one length and no nulls."""
    sizes = [F.size(daily[f]) for f in fields]
    even = F.array_distinct(F.array(*sizes))
    whole = F.lit(True)
    for f in fields:
        whole = whole & ~F.exists(F.coalesce(daily[f], F.array()), lambda x: x.isNull())
    return F.when((F.size(even) == 1) & (sizes[0] >= 0) & whole, F.arrays_zip(*[daily[f].alias(f) for f in fields]))
