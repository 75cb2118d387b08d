"""When a service or a road is active."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runs_on(day: Column, start: Column, end: Column, weekdays: Column, added: Column, removed: Column) -> Column:
    """removed beats added beats range and weekday (Monday is 0)."""
    has = lambda days: F.coalesce(F.array_contains(days, day), F.lit(False))
    return F.when(has(removed), False).when(has(added), True).otherwise(day.between(start, end) & F.array_contains(weekdays, F.weekday(day)))


def is_active(day: Column, calendar: Column, open_months: Column, required: Column, forbidden: Column, conditions: list[str]) -> Column:
    """calendar: runs_on or null (always); months empty: all; all required conditions present, no forbidden one."""
    cond = F.array(*map(F.lit, conditions)).cast("array<string>")
    months = (F.size(open_months) == 0) | F.array_contains(open_months, F.month(day))
    return F.coalesce(calendar, F.lit(True)) & months & (F.size(F.array_except(required, cond)) == 0) & (F.size(F.array_intersect(forbidden, cond)) == 0)


def open_months(tags: Column, keys: list[str]) -> Column:
    """Months left open by the first recognised closure `no @ (Mon-Mon)` among the keys; empty if there is none."""
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    number = F.create_map(*[F.lit(x) for i, m in enumerate(names) for x in (m, i + 1)])
    pattern = r"(?i)no\s*@\s*\(?\s*([A-Za-z]{3})\s*-\s*([A-Za-z]{3})"
    out = F.array().cast("array<int>")
    for key in reversed(keys):
        value = F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))
        a, b = (F.try_element_at(number, F.lower(F.regexp_extract(value, pattern, g))) for g in (1, 2))
        closed = F.when(a <= b, F.sequence(a, b)).otherwise(F.array_union(F.sequence(a, F.lit(12)), F.sequence(F.lit(1), b)))
        left = F.array_except(F.sequence(F.lit(1), F.lit(12)), closed)
        out = F.when(a.isNotNull() & b.isNotNull() & (F.size(left) > 0), left).otherwise(out)
    return out
