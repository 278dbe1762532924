"""The event-hour panel and its checks on days without a model, skipped hours and wrong inputs."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.operators import audit, models

TZ = "Europe/Stockholm"
D1, DST, D3 = date(2024, 3, 30), date(2024, 3, 31), date(2024, 4, 1)  # the clock skips 02:00 of the second day


@pytest.fixture(scope="module")
def inputs(spark):
    events = spark.createDataFrame(
        [("g", "generation", "avail", 50.0, datetime(2024, 3, 30, 10), datetime(2024, 4, 1, 5)), ("t", "transmission", "line", 20.0, datetime(2024, 3, 31, 0, 30), datetime(2024, 3, 31, 8))],
        "event_id string, kind string, driver string, reduction double, start timestamp, end timestamp")
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    days = spark.createDataFrame([(D1,), (DST,)], "day date")  # the third day has no model
    drv = spark.createDataFrame([("avail",), ("line",)], "driver string").crossJoin(spark.createDataFrame([(D1,), (DST,), (D3,)], "day date"))
    gates = drv.select("driver", "day", F.lit(100.0).alias("value"))
    realised = drv.crossJoin(hours).select("driver", "day", "hour", (F.lit(100.0) - F.col("hour")).alias("value"))
    features = gates.crossJoin(hours).select("day", models.override_feature(F.col("driver"), F.col("hour")).alias("feature"), "value")
    terms = features.join(days, "day").select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), "feature", F.lit(0.01).alias("coef"), F.lit(90.0).alias("x_median"), F.lit(5.0).alias("x_mad"))
    heads = days.crossJoin(hours).select("day", "hour", F.lit(0.1).alias("intercept"), F.lit(40.0).alias("y_median"), F.lit(8.0).alias("y_mad"))
    actuals = drv.select("day").distinct().crossJoin(hours).select("day", "hour", F.lit(41.0).alias("y"), F.lit(None).cast("double").alias("stored"))
    return events, realised, gates, features, terms, heads, actuals


def test_scenarios_are_whole_predictions(spark, inputs):
    events, realised, gates, features, terms, heads, _ = inputs
    days = events.select("driver", "kind").crossJoin(spark.createDataFrame([(D1,), (D3,)], "day date"))
    got = audit.scenario_forecasts(days, realised, gates, features, terms, heads).collect()
    assert {(r.driver, r.day) for r in got} == {("avail", D1), ("line", D1)} and len(got) == 48
    z = lambda v: np.arcsinh((v - 90.0) / 5.0)
    level = lambda own: 40.0 + 8.0 * np.sinh(0.1 + 0.01 * (24 * z(100.0) + own))
    for r in got:
        assert r.baseline == pytest.approx(level(24 * z(100.0)))
        assert r.oracle == pytest.approx(level(sum(z(100.0 - h) for h in range(24))))
        assert r.perturbed == pytest.approx(level(24 * z(0.0 if r.kind == "generation" else 200.0)))


def test_panel_holds_days_with_a_model_only(inputs):
    events, realised, gates, features, terms, heads, actuals = inputs
    days = events.select("event_id", "driver", "kind", F.explode(F.array(*[F.lit(d) for d in (D1, DST, D3)])).alias("day"))
    fc = audit.scenario_forecasts(days, realised, gates, features, terms, heads)
    panel = audit.event_hour_panel(events, realised, gates, actuals, fc, TZ)
    got = panel.groupBy("event_id", "day").agg(F.count("baseline").alias("n")).collect()
    assert {(r.event_id, r.day, r.n) for r in got} == {("g", D1, 24), ("g", DST, 24), ("t", DST, 24)}


def test_checks_find_what_is_wrong(spark, inputs):
    events, realised, gates, features, terms, heads, actuals = inputs
    days = spark.createDataFrame([("g", "generation", "avail", D1), ("g", "generation", "avail", DST), ("g", "generation", "avail", D3), ("t", "transmission", "line", DST)],
                                 "event_id string, kind string, driver string, day date")
    fc = audit.scenario_forecasts(days, realised, gates, features, terms, heads)
    panel = audit.event_hour_panel(events, realised, gates, actuals, fc, TZ)
    gate = gates.select("driver", "day", F.col("value").alias("gate_expected"))
    profile = realised.select("driver", "day", "hour", F.col("value").alias("profile_expected"))
    injected = panel.select("event_id", "day", "hour", (F.col("driver_persistence") + models.signed(F.col("kind") == "generation", F.col("reduction"))).alias("value"))
    sound = audit.audit_results(days, panel, gate, profile, features, injected)
    counts = {r["check"]: (r.passed, r.failed) for r in audit.audit_invariants(sound).collect()}
    skipped = 2  # 02:00 of the second day has an actual in both events
    assert counts == {"model_coverage": (3, 1), "feature_wiring": (3, 0), "baseline_persistence": (3, 0), "oracle_path": (3, 0), "generation_sign": (2, 0),
                      "transmission_sign": (1, 0), "event_interval_alignment": (72 - skipped, skipped)}
    rows = {(r["check"], r.event_id, r.day, r.hour) for r in audit.audit_failures(sound).collect()}
    assert rows == {("model_coverage", "g", D3, None), ("event_interval_alignment", "g", DST, 2), ("event_interval_alignment", "t", DST, 2)}
    wrong = audit.audit_results(
        days, panel, gate.withColumn("gate_expected", F.when(F.col("driver") == "line", None).otherwise(F.col("gate_expected"))),
        profile.withColumn("profile_expected", F.col("profile_expected") + F.when((F.col("hour") == 23) & (F.col("day") == D1), 1).otherwise(0)),
        features.where("feature NOT IN ('avail_d_h03', 'avail_d_h01')"), injected.withColumn("value", 200 - F.col("value")))
    found = {(r["check"], r.event_id, r.day): r.detail for r in audit.audit_failures(wrong).collect() if r.hour is None}
    assert found[("feature_wiring", "g", D1)] == "missing features: avail_d_h01, avail_d_h03"
    assert set(found) == {("model_coverage", "g", D3), ("baseline_persistence", "t", DST), ("oracle_path", "g", D1), ("feature_wiring", "g", D1), ("feature_wiring", "g", DST),
                          ("generation_sign", "g", D1), ("generation_sign", "g", DST), ("transmission_sign", "t", DST)}


def test_no_events(inputs):
    events, realised, gates, features, terms, heads, actuals = inputs
    days = events.limit(0).select("event_id", "driver", "kind", F.lit(D1).alias("day"))
    fc = audit.scenario_forecasts(days, realised, gates, features, terms, heads)
    assert audit.event_hour_panel(events.limit(0), realised, gates, actuals, fc, TZ).isEmpty()
