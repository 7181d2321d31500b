"""Weekday and exchange-clock arithmetic on columns. Holidays are not modelled."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPEN, CLOSE, PRE, POST = 570, 960, 240, 1200     # minutes of the exchange day
SESSION = CLOSE - OPEN
ZONE = "America/New_York"


def exchange_time(utc: Column) -> Column:
    """Zone-less UTC time to zone-less exchange time, whatever the session time zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc)


def minutes_of(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def market_session(utc: Column) -> Column:
    et = exchange_time(utc)
    m, weekday = minutes_of(et), F.weekday(et) < 5
    return (F.when(weekday & (m >= OPEN) & (m < CLOSE), "open")
            .when(weekday & (m >= PRE) & (m < OPEN), "pre-market")
            .when(weekday & (m >= CLOSE) & (m < POST), "after-hours").otherwise("closed"))


def sessions_after(day: Column, n: int) -> Column:
    """The n-th weekday after a date."""
    days = F.sequence(F.date_add(day, 1), F.date_add(day, 2 * n + 3))
    return F.element_at(F.filter(days, lambda d: F.weekday(d) < 5), n) if n else day


def _weekdays_to(day: Column) -> Column:
    """Weekdays from a fixed Monday up to and including `day`."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4)) + 1


def business_days_between(a: Column, b: Column) -> Column:
    """Signed count of weekdays after the earlier date up to and including the later one."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (_weekdays_to(hi) - _weekdays_to(lo)) * F.when(a <= b, 1).otherwise(-1)


def elapsed_trading_days(a: Column, b: Column) -> Column:
    """Weekdays between two exchange times plus the share of the session that passed."""
    clamp = lambda t: F.least(F.greatest(minutes_of(t), F.lit(OPEN)), F.lit(CLOSE))
    return business_days_between(a.cast("date"), b.cast("date")) + (clamp(b) - clamp(a)) / SESSION


def next_market_open(utc: Column) -> tuple[Column, Column]:
    """Exchange time of the next opening, and whole minutes until it."""
    et = exchange_time(utc)
    day, m = et.cast("date"), F.hour(et) * 60 + F.minute(et)
    late = (m >= OPEN) | (F.weekday(et) >= 5)
    first = F.when(late, F.date_add(day, 1)).otherwise(day)
    open_day = F.date_add(first, F.when(F.weekday(first) == 5, 2).when(F.weekday(first) == 6, 1).otherwise(0))
    seconds = F.hour(et) * 3600 + F.minute(et) * 60 + F.second(et)
    away = F.datediff(open_day, day) * 86400 + OPEN * 60 - seconds
    return open_day, F.floor(away / 60)
