"""Calendar expressions. Instants are UTC timestamps, the session zone is UTC,
so a "wall" timestamp is a UTC-typed value that shows local clock time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def wall(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(wall(ts, tz))


def local_hour(ts: Column, tz: str) -> Column:
    return F.hour(wall(ts, tz))


def instant_of_wall(w: Column, tz: str) -> Column:
    """Wall clock -> instant. A repeated hour gives its first occurrence, a skipped hour gives NULL."""
    at = F.to_utc_timestamp(w, tz)
    return F.when(F.from_utc_timestamp(at, tz) == w, at)


def hour_label(day: Column, hour: Column, tz: str) -> Column:
    w = day.cast("timestamp") + F.make_dt_interval(F.lit(0), hour.cast("int"))
    return instant_of_wall(w, tz)


def gate_time(day: Column, tz: str, hour: int = 12) -> Column:
    """Forecast origin: `hour` o'clock on the previous calendar day, as an instant."""
    w = F.date_sub(day, 1).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour))
    return F.to_utc_timestamp(w, tz)


def day_start(day: Column, tz: str) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isNotNull(), "autumn")
    )


def spring_flood(month: Column) -> Column:
    """Months in which melt water makes a reservoir effect plausible."""
    return month.isin(4, 5, 6)


def weekday_aware_lag(day: Column) -> Column:
    """Days to look back: a week for Saturday, Sunday and Monday, else one day (0 = Monday)."""
    return F.when(F.weekday(day).isin(0, 5, 6), F.lit(7)).otherwise(F.lit(1))


def hour_index(ts: Column) -> Column:
    """Hours since the epoch, rounded down."""
    return F.floor(F.unix_micros(ts) / F.lit(MICROS_PER_HOUR)).cast("bigint")


def hour_index_up(ts: Column) -> Column:
    """Hours since the epoch of the first full hour at or after `ts`."""
    return F.ceil(F.unix_micros(ts) / F.lit(MICROS_PER_HOUR)).cast("bigint")


def instant_of_hour_index(h: Column) -> Column:
    return F.timestamp_seconds(h * F.lit(3600))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(seconds_between(F.greatest(a_start, b_start), F.least(a_end, b_end)), F.lit(0.0))


def overlap_fraction(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap divided by the shorter of the two durations; 0 when they do not overlap."""
    over = overlap_seconds(a_start, a_end, b_start, b_end)
    shorter = F.least(seconds_between(a_start, a_end), seconds_between(b_start, b_end))
    return F.when((over > 0) & (shorter > 0), over / shorter).otherwise(F.lit(0.0))
