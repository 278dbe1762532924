"""paths side by side give what rows of paths give, and do not become rows."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from hourloom.operators import models as mo

D = date(2024, 1, 5)
K = ["event_id", "day"]


@pytest.mark.parametrize("local", [0, 200_000])
def test_paths_side_by_side_equal_rows_of_paths(spark, monkeypatch, local):
    monkeypatch.setattr(mo, "LOCAL_CELLS", local)
    r = random.Random(local)
    terms = spark.createDataFrame(
        [(D, h, f"error_d_h{k:02d}", r.uniform(-1, 1), 50.0, 30.0) for h in range(23) for k in r.sample(range(24), 5)] + [(D, 3, "error_lag1", 2.0, 50.0, 30.0)],
        "day date, hour int, feature string, coef double, x_median double, x_mad double")
    features = spark.createDataFrame([(D, f"error_d_h{k:02d}", None if k == 4 else r.uniform(0, 99)) for k in range(24)], "day date, feature string, value double")
    scores = spark.createDataFrame([(D, h, r.uniform(-2, 2), 40.0, 9.0) for h in range(24)], "day date, hour int, score double, y_median double, y_mad double")
    effects = spark.createDataFrame(
        [(f"e{i}", D, i % 2 == 0, "none" if i == 3 else "reduce", 0.7, 5.0 * i, 1.5 * (i % 2), 5.0 * i + 6, 2.0, 3.0, 6.0, 9.0 if i else 3.0, i != 1) for i in range(4)],
        "event_id string, day date, falls boolean, direction string, p_active double, start_mean double, start_sd double, end_mean double, end_sd double, p10 double, p50 double, p90 double, doc boolean")
    effects = effects.withColumn("p50", F.when(F.col("p90") == F.col("p10"), F.col("p10")).otherwise(F.col("p50")))
    base = spark.createDataFrame([(f"e{i}", D, h, None if h == 9 else r.uniform(0, 99)) for i in range(4) for h in range(24)], "event_id string, day date, hour int, value double")
    drivers = effects.select(*K, F.lit("error").alias("series"), "doc")
    over = lambda t: t.join(drivers.drop("doc"), K)
    baseline = mo.level(mo.what_if_scores(scores, over(base), features, terms, [], ["event_id"]))
    sampled = mo.level(mo.what_if_scores(scores, over(mo.effect_to_paths(base, effects, K, 6, 42)), features, terms, [], ["event_id", "path"]))
    oracle = mo.level(drivers.select(*K).join(scores, "day"))
    want = {x[:4]: x.point for x in mo.conditions_union(baseline, oracle, sampled, effects.where("doc"), K).collect()}
    wide = mo.path_scores(scores, base, effects, drivers, features, terms, K, 6, 42, along=["doc"])
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    got = {x[:4]: x.point for x in mo.path_conditions(wide, 6, F.col("doc"), K).collect()}
    assert len(got) == len(want) == 4 * 24 * 3
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert any(abs(got[("e0", D, h, "context")] - got[("e0", D, h, "no_context")]) > 1e-3 for h in range(24))
