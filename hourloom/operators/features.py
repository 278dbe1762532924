"""Day/hour profiles, lags and the long feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import running, timeline


def day_hour_profile(hourly: DataFrame, by: list[str], ts: str, value: str, tz: str) -> DataFrame:
    """24 slots per key and local day: the first value of each wall-clock hour, NULL where the hour is absent."""
    local = hourly.select(
        *by, cal.local_day(F.col(ts), tz).alias("day"), cal.local_hour(F.col(ts), tz).alias("hour"), ts, value
    )
    first = timeline.dedup_index_first(local, [*by, "day", "hour"], [ts])
    # slots of a day travel as one row of 24 cells, so the spine needs no join
    cells = first.groupBy(*by, "day").agg(F.map_from_entries(F.collect_list(F.struct("hour", value))).alias("__m"))
    return cells.select(
        *by, "day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), "__m"
    ).select(*by, "day", "hour", F.try_element_at("__m", F.col("hour")).alias(value))


def shifted(profile: DataFrame, by: list[str], value: str, lags: list[int]) -> DataFrame:
    """Long lags `(by, day, hour, lag, value)`: each value is sent to the days that look back at it."""
    return profile.select(
        *by, "day", "hour", F.col(value).alias("value"), F.explode(F.array(*map(F.lit, lags))).alias("lag")
    ).withColumn("day", F.date_add("day", F.col("lag")))


def lag_day_join(profile: DataFrame, by: list[str], value: str, lags: list[int]) -> DataFrame:
    """Add `lag<k>`: the value of the same hour k calendar days before, for days that exist.

    All lags share one shuffle on (key, day, hour) instead of one self-join each.
    """
    long = shifted(profile, by, value, [0, *lags])
    at = lambda k: F.max(F.when(F.col("lag") == k, F.col("value")))
    wide = long.groupBy(*by, "day", "hour").agg(
        F.max(F.col("lag") == 0).alias("__own"), at(0).alias(value), *[at(k).alias(f"lag{k}") for k in lags]
    )
    return wide.where("__own").drop("__own")


def naive_weekday_aware(profile: DataFrame, by: list[str], value: str) -> DataFrame:
    """Naive forecasts: the day before (a week before on Sat, Sun, Mon), and always the day before."""
    lagged = lag_day_join(profile, by, value, [1, 7])
    weekly = cal.weekday_aware_lag(F.col("day")) == 7
    return lagged.select(
        *by, "day", "hour", value,
        F.when(weekly, F.col("lag7")).otherwise(F.col("lag1")).alias("naive"),
        F.col("lag1").alias("naive_lag24"),
    )


def asof_gate_value(
    hourly: DataFrame, by: list[str], ts: str, value: str, days: DataFrame, tz: str, gate_hour: int = 12,
    bucket: str = "month",
) -> DataFrame:
    """Per key and day, the last known value at the forecast origin of that day."""
    probes = days.select(*by, "day", cal.gate_time(F.col("day"), tz, gate_hour).alias(ts))
    points = hourly.select(*by, ts, value, F.lit(None).cast("date").alias("day"), F.lit(0).alias("__probe"))
    both = points.unionByName(
        probes.select(*by, ts, F.lit(None).cast("double").alias(value), "day", F.lit(1).alias("__probe"))
    )
    known = running.carry_forward(both, by, ts, {value: "__k"}, bucket, tie=[F.col("__probe"), F.col("day")])
    return known.where("__probe = 1").select(*by, "day", F.col(ts).alias("gate"), F.col("__k").alias(value))


def calendar_features(days: DataFrame, holidays: DataFrame | None = None, harmonics: int = 2) -> DataFrame:
    """Per day: weekday one-hot, holiday flag (from an input table with column `day`), yearly sine and cosine."""
    out = days
    if holidays is not None:
        marked = holidays.select("day").distinct().withColumn("__h", F.lit(1.0))
        out = out.join(marked, "day", "left").withColumn("is_public_holiday", F.coalesce("__h", F.lit(0.0))).drop("__h")
    else:
        out = out.withColumn("is_public_holiday", F.lit(0.0))
    for i in range(7):
        out = out.withColumn(f"weekday_{i}", F.when(F.weekday("day") == i, 1.0).otherwise(0.0))
    angle = F.lit(6.283185307179586) * F.dayofyear("day") / F.lit(365.25)
    for k in range(1, harmonics + 1):
        out = out.withColumn(f"fourier_sin_{k}", F.sin(angle * k)).withColumn(f"fourier_cos_{k}", F.cos(angle * k))
    return out


def _calendar_long(days: DataFrame, by: list[str], holidays: DataFrame | None) -> DataFrame:
    wide = calendar_features(days.select(*by, "day").distinct(), holidays)
    names = [c for c in wide.columns if c not in (*by, "day")]
    return wide.unpivot([*by, "day"], names, "feature", "value")


def feature_matrix(
    profile: DataFrame, by: list[str], series: str, value: str, target: str, exog: list[str], slow: str,
    days: DataFrame, target_lags: list[int] = [1, 2, 3, 7], exog_lags: list[int] = [0, 1, 7], slow_lag: int = 7,
    holidays: DataFrame | None = None, override: DataFrame | None = None,
) -> DataFrame:
    """Long features `(by, day, feature, value)` of the listed days.

    Price lags, exogenous columns of the day and its lags, the slow column's daily mean a week back, and
    calendar columns. `override (by, day, series, hour, value)` replaces the same-day block of its columns.
    One pass over the profile: every value is sent to the (day, feature) cells it feeds.
    """
    tag = F.when(F.col("lag") == 0, F.lit("d")).otherwise(F.concat(F.lit("dminus"), F.col("lag"), F.lit("d")))
    hh = F.format_string("h%02d", F.col("hour").cast("int"))
    lags = (
        F.when(F.col(series) == target, F.array(*map(F.lit, target_lags)))
        .when(F.col(series).isin(*exog), F.array(*map(F.lit, exog_lags)))
    )
    sent = (
        profile.where(F.col(series).isin(target, *exog))
        .select(*by, series, "day", "hour", F.col(value).alias("value"), F.explode(lags).alias("lag"))
        .withColumn("day", F.date_add("day", F.col("lag")))
    )
    if override is not None:
        o = override.select(*by, "day", series, "hour", F.col("value").alias("__o"), F.lit(0).alias("lag"))
        sent = sent.join(o, [*by, "day", series, "hour", "lag"], "left").withColumn("value", F.coalesce("__o", "value"))
    name = F.when(
        F.col(series) == target, F.concat(F.lit("price_lag"), F.col("lag"), F.lit("d_"), hh)
    ).otherwise(F.concat(F.col(series), F.lit("_"), tag, F.lit("_"), hh))
    cells = sent.select(*by, "day", name.alias("feature"), "value")
    mean = (
        profile.where(F.col(series) == slow).groupBy(*by, F.date_add("day", slow_lag).alias("day"))
        .agg(F.avg(value).alias("value"))
        .select(*by, "day", F.lit(f"{slow}_mean_dminus{slow_lag}d").alias("feature"), "value")
    )
    wanted = days.select(*by, "day").distinct()
    data = cells.unionByName(mean).join(wanted, [*by, "day"], "left_semi")
    return data.unionByName(_calendar_long(wanted, by, holidays).select(*by, "day", "feature", "value"))


def feature_vectors(features: DataFrame, by: list[str]) -> DataFrame:
    """One row per day: values in feature-name order. A day has a fixed number of features, so the list is bounded."""
    cells = F.sort_array(F.collect_list(F.struct("feature", "value")))
    return features.groupBy(*by, "day").agg(cells.alias("__c")).select(
        *by, "day", F.col("__c.feature").alias("names"), F.col("__c.value").alias("x")
    )


def calibration_window(features: DataFrame, by: list[str], days: DataFrame, window: int) -> DataFrame:
    """Rows of the `window` days before each delivery day, tagged with it (`delivery`)."""
    wanted = days.select(*by, F.col("day").alias("delivery")).distinct()
    sent = features.withColumn(
        "delivery", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", window)))
    )
    return sent.join(wanted, [*by, "delivery"], "left_semi")


def robust_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation per group of bounded size (a calibration window)."""
    med = df.groupBy(*by).agg(F.median(value).alias("median"))
    joined = df.join(med, by)
    return joined.groupBy(*by, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
