"""Tolerant readers of tag and timetable texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAR_ACCESS = ("yes", "designated", "permissive", "official")


def maxspeed(value: Column, fallback: Column) -> Column:
    """km/h from a number, with mph converted; anything else, or zero, is the fallback."""
    v = F.lower(F.trim(value))
    number = F.regexp_extract(v, r"\d+(\.\d+)?", 0).try_cast("double")
    speed = F.when(v.contains("mph"), number * 1.609344).otherwise(number)
    return F.when(speed > 0, speed).otherwise(fallback)


def duration_seconds(value: Column) -> Column:
    """H:MM, H:MM:SS or minutes; null if not positive or not readable."""
    v = F.trim(value)
    number = r"\d+(\.\d+)?"
    part = lambda i: F.get(F.split(v, ":"), F.lit(i)).try_cast("double")
    total = F.when(v.rlike(f"^{number}$"), v.try_cast("double") * 60).when(v.rlike(f"^{number}:{number}(:{number})?$"), part(0) * 3600 + part(1) * 60 + F.coalesce(part(2), F.lit(0.0)))
    return F.when(total > 0, total)


def oneway(tag: Column, junction: Column) -> Column:
    """1 forward, -1 backward, 0 both; roundabouts without the tag are forward."""
    v = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    return F.when(v.isin("yes", "true", "1"), 1).when(v.isin("-1", "reverse"), -1).when((junction == "roundabout") & (v == ""), 1).otherwise(0)


def car_ferry(tags: Column) -> Column:
    get = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    car, motor = get("motorcar"), get("motor_vehicle")
    return (get("route") == "ferry") & (car != "no") & (motor != "no") & (car.isin(*CAR_ACCESS) | motor.isin(*CAR_ACCESS))


def gtfs_seconds(value: Column) -> Column:
    """H:MM or H:MM:SS from service-day midnight; hours may pass 24; null if not readable."""
    p = F.split(F.trim(value), ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p).isin(2, 3), n(0) * 3600 + n(1) * 60 + F.when(F.size(p) == 3, n(2)).otherwise(0))


def route_mode(kind: Column) -> Column:
    """GTFS route types, basic and extended; unknown or unreadable ones are rail."""
    k = F.coalesce(kind.try_cast("double").try_cast("int"), F.lit(2))
    return F.when((k == 4) | (k.between(1000, 1099)) | (k == 1200), "ferry").when(k.between(1100, 1199), "flight").otherwise("train")


def place_key(label: Column) -> Column:
    """What stands before the first comma, trimmed and in lower case."""
    return F.lower(F.trim(F.split_part(label, F.lit(","), F.lit(1))))


def depart(text: Column, default: Column) -> Column:
    """A departure in one of four forms; the default if empty, null if not readable."""
    t = F.trim(F.coalesce(text, F.lit("")))
    forms = ["yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss"]
    read = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in forms])
    return F.when(t == "", default).otherwise(read)
