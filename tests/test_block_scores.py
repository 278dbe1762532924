import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from hourloom.operators import models as mo

D = date(2024, 1, 5)
K = ["event_id", "day"]


@pytest.mark.parametrize("local", [0, 200_000])
def test_placements_side_by_side_equal_rows_of_placements(spark, monkeypatch, local):
    monkeypatch.setattr(mo, "LOCAL_CELLS", local)
    r = random.Random(local)
    terms = spark.createDataFrame(
        [(D, h, f"error_d_h{k:02d}", r.uniform(-1, 1), 50.0, 30.0) for h in range(24) for k in r.sample(range(24), 5)] + [(D, 3, "error_lag1", 2.0, 50.0, 30.0)],
        "day date, hour int, feature string, coef double, x_median double, x_mad double")
    features = spark.createDataFrame([(D, f"error_d_h{k:02d}", None if k == 4 else r.uniform(0, 99)) for k in range(24)], "day date, feature string, value double")
    scores = spark.createDataFrame([(D, h, r.uniform(-2, 2), 40.0, 9.0) for h in range(24)], "day date, hour int, score double, y_median double, y_mad double")
    events = spark.createDataFrame([("e1", D, True, 20.0, 3.5), ("e2", D, False, 7.0, 80.0), ("e3", D, True, 1.0, -1.0)], "event_id string, day date, falls boolean, size double, width_hours double")
    base = spark.createDataFrame([(e, D, h, None if h == 9 else r.uniform(0, 99)) for e in ("e1", "e2", "e3") for h in range(24)], "event_id string, day date, hour int, value double")
    drivers = events.select(*K, F.lit("error").alias("series"))
    rows = mo.block_paths(base, events, K).join(drivers, K)
    long = mo.level(mo.what_if_scores(scores, rows, features, terms, [], ["event_id", "start_hour"]))
    want = {(x.event_id, x.hour, x.start_hour): x.point for x in long.collect()}
    wide = mo.block_points(mo.block_scores(scores, base, events, drivers, features, terms, K), K)
    got = {(x.event_id, x.hour, s): p for x in wide.collect() for s, p in enumerate(x.points)}
    assert len(got) == len(want) == 3 * 24 * 24
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    scored = base.select(*K, "hour", (F.col("hour") * 2.5).alias("y"), F.lit(40.0).alias("baseline"), F.lit(44.0).alias("context"))
    a, b = (sorted(map(tuple, mo.random_block_control(p, scored, K, 50, 7).collect())) for p in (long, wide))
    assert len(a) == 3 and all(x[2:] == pytest.approx(y[2:], abs=1e-9) for x, y in zip(a, b, strict=True))
