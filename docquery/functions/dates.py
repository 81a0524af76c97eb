"""Date expressions: local calendars by conversion of wall clocks, fixed units by arithmetic on milliseconds."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.compare import Typed, as_date, as_double
from docquery.plans.expressions import DAYS

UNIT_MS = {"hour": 3_600_000, "minute": 60_000, "second": 1_000, "millisecond": 1}
REF_DAY, REF_MS = 10_957, 946_684_800_000  # 2000-01-01
DATE = T.TimestampNTZType()


def null_date() -> Typed:
    return Typed(F.lit(None).cast(DATE), DATE)


def null_number() -> Typed:
    return Typed(F.lit(None).cast("double"), T.DoubleType())


def local(t: Column, zone: str) -> Column:
    return t if zone in ("UTC", "+00:00") else F.convert_timezone(F.lit("UTC"), F.lit(zone), t)


def absolute(t: Column, zone: str) -> Column:
    return t if zone in ("UTC", "+00:00") else F.convert_timezone(F.lit(zone), F.lit("UTC"), t)


def to_ms(t: Column) -> Column:
    """Milliseconds since 1970 of a wall clock read as UTC, whatever the session's zone is."""
    days = F.unix_date(t.cast("date")).cast("long")
    within = F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + F.floor(F.date_part(F.lit("SECOND"), t).cast("decimal(10,6)") * 1000)
    return days * 86_400_000 + within.cast("long")


def from_ms(ms: Column) -> Column:
    return F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms.cast("decimal(24,0)") / 1000).cast("decimal(18,6)"))


def at_midnight(days: Column) -> Column:
    return F.date_add(F.expr("date '1970-01-01'"), days.cast("int")).cast("timestamp_ntz")


def months(t: Column) -> Column:
    return F.year(t).cast("long") * 12 + F.month(t) - 1


def month_start(m: Column) -> Column:
    return F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def week_index(t: Column, start: str) -> Column:
    first = DAYS.index(start)  # 1970-01-04 was a Sunday
    return F.floor((F.unix_date(t.cast("date")) - F.lit(3 + first)) / 7)


def date_add(start: Typed, unit: str, amount: Typed, zone: str) -> Typed:
    if start.kind != "date" or amount.kind != "num":
        return null_date()
    n = as_double(amount)
    whole = F.when((n == F.floor(n)) & (F.abs(n) < 1e9 if unit not in UNIT_MS else F.abs(n) < 1e15), n.cast("long"))
    t = as_date(start)
    if unit in UNIT_MS:
        return Typed(from_ms(to_ms(t) + whole * UNIT_MS[unit]), DATE)
    wall = local(t, zone)
    if unit in ("week", "day"):
        moved = wall + F.make_dt_interval((whole * (7 if unit == "week" else 1)).cast("int"))
    else:
        moved = wall + F.make_ym_interval(F.lit(0), (whole * {"year": 12, "quarter": 3, "month": 1}[unit]).cast("int"))
    return Typed(absolute(moved, zone), DATE)


def date_diff(start: Typed, end: Typed, unit: str, zone: str, week: str) -> Typed:
    """How many boundaries of the unit lie between the two."""
    if start.kind != "date" or end.kind != "date":
        return null_number()

    def index(x: Typed) -> Column:
        t = as_date(x)
        if unit in UNIT_MS:
            return F.floor(to_ms(t) / UNIT_MS[unit])
        w = local(t, zone)
        return {"year": lambda: F.year(w).cast("long"), "quarter": lambda: F.floor(months(w) / 3), "month": lambda: months(w), "week": lambda: week_index(w, week), "day": lambda: F.unix_date(w.cast("date")).cast("long")}[unit]()

    return Typed((index(end) - index(start)).cast("double"), T.DoubleType())


def date_trunc(date: Typed, unit: str, size: int, zone: str, week: str) -> Typed:
    """The start of the bin of `size` units, counted from 2000-01-01 (weeks: from the first start of a week then)."""
    if date.kind != "date":
        return null_date()
    t = as_date(date)
    wall = local(t, zone)
    if unit in UNIT_MS:
        return Typed(from_ms(to_ms(t) - F.pmod(to_ms(wall) - REF_MS, F.lit(size * UNIT_MS[unit]))), DATE)
    if unit in ("week", "day"):
        days, ref, width = F.unix_date(wall.cast("date")).cast("long"), REF_DAY, size
        if unit == "week":
            ref, width = REF_DAY + (DAYS.index(week) - 6) % 7, size * 7
        return Typed(absolute(at_midnight(days - F.pmod(days - ref, F.lit(width))), zone), DATE)
    width = size * {"year": 12, "quarter": 3, "month": 1}[unit]
    m = months(wall)
    return Typed(absolute(month_start(m - F.pmod(m - 2000 * 12, F.lit(width))), zone), DATE)


def year(date: Typed, zone: str) -> Typed:
    return Typed(F.year(local(as_date(date), zone)).cast("double"), T.DoubleType()) if date.kind == "date" else null_number()


def week(date: Typed, zone: str) -> Typed:
    """Weeks from Sunday, 0 before the year's first."""
    if date.kind != "date":
        return null_number()
    w = local(as_date(date), zone)
    return Typed(F.floor((F.dayofyear(w) - 1 + 7 - (F.dayofweek(w) - 1)) / 7).cast("double"), T.DoubleType())


def compile_date(name: str, named: dict[str, Any], arg: Any) -> Typed:
    zone, first = named.get("timezone", "UTC"), named.get("startOfWeek", "sunday")
    if name == "$dateAdd":
        return date_add(arg("startDate"), named["unit"], arg("amount"), zone)
    if name == "$dateDiff":
        return date_diff(arg("startDate"), arg("endDate"), named["unit"], zone, first)
    if name == "$dateTrunc":
        return date_trunc(arg("date"), named["unit"], named.get("binSize", 1), zone, first)
    return (year if name == "$year" else week)(arg("date"), zone)
