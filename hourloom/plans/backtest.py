"""Walk-forward evaluation of fitted models, per panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.operators import features as ft
from hourloom.operators import forecast as fc
from hourloom.operators import metrics as mt
from hourloom.operators import models as mo
from hourloom.operators import relations as rel


def target_vectors(profile: DataFrame, by: list[str]) -> DataFrame:
    """24 target values per day, in hour order."""
    cells = F.sort_array(F.collect_list(F.struct("hour", "value")))
    return profile.groupBy(*by, "day").agg(cells.alias("__c")).select(*by, "day", F.col("__c.value").alias("y"))


def persistence_override(hourly: DataFrame, by: list[str], series: list[str], days: DataFrame, tz: str) -> DataFrame:
    """What is known of the availability series at the forecast origin, held for the day."""
    known = hourly.where(F.col("series").isin(*series))
    asked = days.select(*by, "day").distinct().select("*", F.explode(F.array(*map(F.lit, series))).alias("series"))
    gate = ft.asof_gate_value(known, [*by, "series"], "ts", "value", asked, tz)
    return rel.cross_join_expand(gate.select(*by, "series", "day", "value"), "hour", 24)


def backtest(
    hourly: DataFrame, by: list[str], target: str, exog: list[str], slow: str, availability: list[str], days: DataFrame,
    tz: str, window: int, every: int = 1, holidays: DataFrame | None = None, last: int = 90, burn_in: int = 28,
    block_days: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(forecast rows, models). hourly (by, series, ts, value) is filled; days (by, day) is the slice to forecast.

    Models are calibrated on realised inputs; forecasts see the availability series only as known at the origin.
    """
    profile = ft.day_hour_profile(hourly, [*by, "series"], "ts", "value", tz)
    every_day = profile.select(*by, "day").distinct()
    realised = ft.feature_matrix(profile, by, "series", "value", target, exog, slow, every_day, holidays=holidays)
    own = profile.where(F.col("series") == target).drop("series")
    plan = fc.refit_carry_forward(days.select(*by, "day").distinct(), by, "day", every)
    refits = plan.select(*by, F.col("refit_day").alias("day")).distinct()
    models = mo.fit_many_lasso(ft.feature_vectors(realised, by), target_vectors(own, by), refits, by, window, block_days)
    used = plan.join(models, [*by, "refit_day"])
    override = persistence_override(hourly, by, availability, days, tz)
    known = ft.feature_matrix(profile, by, "series", "value", target, exog, slow, days, holidays=holidays, override=override)
    point = mo.predict_linear(known, mo.model_terms(used, by), mo.model_heads(used, by), by)
    return fc.walk_forward(own, by, "value", point, days, tz, every, last, burn_in), models


def choose_window(runs: dict[int, DataFrame]) -> DataFrame:
    """The calibration length with the lowest MAE over its run."""
    scores = None
    for window, rows in runs.items():
        one = rows.agg(mt.mae(F.col("y"), F.col("point")).alias("mae")).withColumn("window", F.lit(window))
        scores = one if scores is None else scores.unionByName(one)
    return mt.select_by_min_metric(scores, "mae", "window")
