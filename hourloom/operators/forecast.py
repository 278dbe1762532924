"""Walk-forward evaluation without a sequential loop: lags and windows stand for the day-by-day state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.functions import numeric as num
from hourloom.operators import features

GRID = num.QUANTILE_GRID


def rolling_residual_quantiles(
    df: DataFrame, by: list[str], day: str, y: str, point: str, out: str, last: int = 90, burn_in: int = 28,
    taus: list[float] = GRID,
) -> DataFrame:
    """Forecast plus the quantiles of the last `last` known residuals of strictly earlier days.

    `by` must include the hour of day, so a window holds one row per day. Rows are ordered by the number of
    residuals known before them; a RANGE over that count is "the last N non-null ones". NULL before burn-in.
    """
    order = Window.partitionBy(*by).orderBy(day)
    known = F.count("__res").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__res", F.col(y) - F.col(point)).withColumn("__c", known)
    span = Window.partitionBy(*by).orderBy("__c").rangeBetween(-last, -1)
    q = F.percentile("__res", F.array(*map(F.lit, taus))).over(span)
    rows = rows.withColumn("__q", F.when(F.col("__c") >= burn_in, q))
    return rows.select(*df.columns, F.transform("__q", lambda x: x + F.col(point)).alias(out))


def refit_carry_forward(days: DataFrame, by: list[str], day: str, every: int, out: str = "refit_day") -> DataFrame:
    """The day whose model is used: the last one with an index divisible by `every`."""
    order = Window.partitionBy(*by).orderBy(day)
    ranked = days.withColumn("__i", F.row_number().over(order) - 1).withColumn("__block", F.floor(F.col("__i") / every))
    first = F.min(day).over(Window.partitionBy(*by, "__block"))
    return ranked.select(*days.columns, first.alias(out))


def walk_forward(
    profile: DataFrame, by: list[str], value: str, point: DataFrame, days: DataFrame, tz: str, every: int = 1,
    last: int = 90, burn_in: int = 28,
) -> DataFrame:
    """Forecast rows: instant, truth, forecast, two naives, refit day and both quantile arrays.

    `point (by, day, hour, point)` is the forecast to judge; `days (by, day)` the slice.
    """
    naive = features.naive_weekday_aware(profile, by, value).withColumnRenamed(value, "y")
    slice_days = refit_carry_forward(days.select(*by, "day").distinct(), by, "day", every)
    rows = naive.join(slice_days, [*by, "day"]).join(point, [*by, "day", "hour"], "left")
    rows = rows.withColumn("ts", cal.hour_label(F.col("day"), F.col("hour"), tz))
    hourly = [*by, "hour"]
    rows = rolling_residual_quantiles(rows, hourly, "day", "y", "point", "q", last, burn_in)
    return rolling_residual_quantiles(rows, hourly, "day", "y", "naive", "naive_q", last, burn_in)
