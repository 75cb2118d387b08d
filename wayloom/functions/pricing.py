"""Fares, emissions and congestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base and per-km rate of a fare, and grams of CO2 per km, by mode.
FARES = {"walk": (0.0, 0.0), "car": (0.0, 0.15), "train": (2.50, 0.12), "ferry": (5.0, 0.15), "flight": (45.0, 0.07)}
OTHER_FARE = (0.0, 0.20)
EMISSIONS = {"walk": 0.0, "train": 35.0, "ferry": 120.0, "car": 170.0, "flight": 250.0}
OTHER_EMISSIONS = 120.0
#: Slowdown of free flow by road class.
AVERAGE = {
    "motorway": 1.05, "motorway_link": 1.10, "trunk": 1.11, "trunk_link": 1.18, "primary": 1.33, "primary_link": 1.40,
    "secondary": 1.43, "secondary_link": 1.50, "tertiary": 1.54, "tertiary_link": 1.60, "unclassified": 1.67,
    "residential": 1.82, "living_street": 2.00, "service": 2.00, "road": 1.54, "track": 2.00,
}
HIGHWAYS = ("motorway", "motorway_link", "trunk", "trunk_link")


def choose(key: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def fare(mode: Column, km: Column) -> Column:
    base = choose(mode, {m: v[0] for m, v in FARES.items()}, OTHER_FARE[0])
    rate = choose(mode, {m: v[1] for m, v in FARES.items()}, OTHER_FARE[1])
    return F.greatest(F.lit(0.0), base + rate * km)


def emissions(mode: Column, km: Column) -> Column:
    return km * choose(mode, EMISSIONS, OTHER_EMISSIONS)


def level(rank: Column) -> Column:
    """A cost level, 1 to 3."""
    return F.greatest(F.lit(1), F.least(F.lit(3), rank))


def table_fare(rates: DataFrame):
    """A fare model from a table (mode, base, per_km), small: a function of legs that adds fare; modes it lacks cost by OTHER_FARE."""

    def priced(legs: DataFrame) -> DataFrame:
        r = rates.select(F.col("mode").alias("__mode"), F.col("base").alias("__base"), F.col("per_km").alias("__rate"))
        cost = F.greatest(F.lit(0.0), F.coalesce("__base", F.lit(OTHER_FARE[0])) + F.coalesce("__rate", F.lit(OTHER_FARE[1])) * F.col("km"))
        return legs.join(r, F.col("mode") == F.col("__mode"), "left").withColumn("fare", cost).drop("__mode", "__base", "__rate")

    return priced


def with_calendar(df: DataFrame, at: str, days: DataFrame) -> DataFrame:
    """df with holiday and school_break of the day of `at` by a table (day, kind: 'holiday' or 'school_break'); days it lacks are neither."""
    kinds = days.groupBy(F.col("day").cast("date").alias("__day")).agg(F.bool_or(F.col("kind") == "holiday").alias("holiday"), F.bool_or(F.col("kind") == "school_break").alias("school_break"))
    none = F.lit(False)
    joined = df.join(kinds, F.col(at).cast("date") == F.col("__day"), "left")
    return joined.withColumns({k: F.coalesce(k, none) for k in ("holiday", "school_break")}).drop("__day")


def speed_factor(road: Column, at: Column, holiday: Column, school_break: Column) -> Column:
    """Slowdown of a road class at a local time. A holiday has no rush hours; a school break halves what a factor has above 1."""
    average = choose(road, AVERAGE, 1.0)
    hour, workday, fast = F.hour(at), F.weekday(at) < 5, road.isin(*HIGHWAYS)
    peak = F.when(fast, 1.20).otherwise(1.45)
    weekday = F.when(hour.isin(7, 8, 16, 17, 18), peak).when((hour >= 22) | (hour <= 5), 0.95).otherwise(1.0)
    weekend = F.when(hour.between(11, 17), F.when(fast, 1.05).otherwise(1.15)).when((hour >= 22) | (hour <= 6), 0.95).otherwise(1.0)
    factor = F.when(workday, weekday).otherwise(weekend)
    factor = F.when(school_break & (factor > 1), 1 + (factor - 1) * 0.5).otherwise(factor)
    quiet = F.when((hour >= 22) | (hour <= 5), 0.95).otherwise(1.0)
    scaled = F.greatest(F.lit(1.0), average * F.when(holiday, quiet).otherwise(factor))
    return F.when(road == "ferry", 1.0).when(at.isNull(), average).otherwise(scaled)
