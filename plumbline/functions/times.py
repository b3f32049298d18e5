"""Time arithmetic on columns and relative windows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(a: Column, b: Column) -> Column:
    """Minute boundaries crossed from `a` to `b` (not elapsed whole minutes)."""
    def minute(c: Column) -> Column:
        return F.unix_timestamp(F.date_trunc("minute", c))

    return ((minute(b) - minute(a)) / 60).cast("bigint")


def period(ts: Column, grain: str) -> Column:
    """First day of the calendar period, as a date."""
    return F.to_date(ts) if grain == "day" else F.trunc(F.to_date(ts), grain)


def _month(day: date, back: int) -> date:
    months = day.year * 12 + day.month - 1 - back
    return date(months // 12, months % 12 + 1, 1)


def window_bounds(window: str | None, as_of: date | datetime) -> tuple[date, date] | None:
    """Half-open [from, to) days of a relative window seen from `as_of`; None means unbounded."""
    today = as_of.date() if isinstance(as_of, datetime) else as_of
    days = timedelta
    match window:
        case None | "all":
            return None
        case "this_month":
            return _month(today, 0), today + days(1)
        case "last_month":
            return _month(today, 1), _month(today, 0)
        case "month_before_last":
            return _month(today, 2), _month(today, 1)
        case "last_3_months":
            return _month(today, 3), _month(today, 0)
        case "yesterday":
            return today - days(1), today
        case "last_week" | "last_7_days":
            return today - days(7), today
        case "week_before_last":
            return today - days(14), today - days(7)
        case _:
            raise ValueError(f"unknown time window {window}")


def window_columns(window: str, as_of: Column) -> tuple[Column, Column]:
    """The same bounds as date columns, for many as-of times at once."""
    today = F.to_date(as_of)

    def month(back: int) -> Column:
        return F.trunc(F.add_months(today, -back), "month")

    bounds = {
        "this_month": (month(0), F.date_add(today, 1)),
        "last_month": (month(1), month(0)),
        "month_before_last": (month(2), month(1)),
        "last_3_months": (month(3), month(0)),
        "yesterday": (F.date_sub(today, 1), today),
        "last_week": (F.date_sub(today, 7), today),
        "last_7_days": (F.date_sub(today, 7), today),
        "week_before_last": (F.date_sub(today, 14), F.date_sub(today, 7)),
        "all": (F.lit(None).cast("date"), F.lit(None).cast("date")),
    }
    if window not in bounds:
        raise ValueError(f"unknown time window {window}")
    return bounds[window]


# The window just before a relative window (fixed values).
PRECEDING = {
    "last_month": "month_before_last",
    "this_month": "last_month",
    "last_week": "week_before_last",
}
