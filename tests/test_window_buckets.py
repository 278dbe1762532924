"""an event is shuffled once per bucket of hours, and intervals are made once for all that is asked of them."""

import random
from datetime import datetime, timedelta

import pytest

from hourloom.operators import matching as ma
from testbed import registry
from testbed.bindings import documents  # noqa: F401  (registers the queries)
from tests.test_overlap_reads import shuffled, unsent  # noqa: F401

T0 = datetime(2024, 1, 1)
EVENTS, DRIVER = "event string, unit long, start timestamp, end timestamp", "unit long, ts timestamp, total double"


def at(hours):
    return T0 + timedelta(hours=hours)


def means(events, driver):
    """Hour after hour: {event: mean}; an event without an hour of the driver has none."""
    out = {}
    for event, unit, a, z in events:
        hours = [a + timedelta(hours=k) for k in range(2000) if a and z and a + timedelta(hours=k) <= z - timedelta(seconds=1)]
        out.setdefault(event, []).extend(x for u, ts, x in driver for _ in range(hours.count(ts)) if unit is not None and u == unit)
    known = {k: [x for x in v if x is not None] for k, v in out.items() if v}
    return {k: sum(v) / len(v) if v else None for k, v in known.items()}


def test_means_are_those_of_the_hours_one_by_one(spark):
    r = random.Random(5)
    driver = [(u, at(h), r.choice([None, 1.5, 2.0, -3.0])) for u in (1, 2) for h in range(900) if r.random() < 0.8] + [(1, at(5), 7.0), (3, at(1), None), (None, at(1), 1.0)]
    bounds = [(h, h + r.randint(-3, 500)) for h in (r.randint(-300, 900) for _ in range(25))] + [(0, 192), (191, 193), (192, 384), (191.5, 194), (0.25, 5), (5, 5.9)]
    events = [(f"e{k}", r.choice([1, 2]), at(a), at(z)) for k, (a, z) in enumerate(bounds)]
    events += [("twice", 1, at(0), at(9)), ("twice", 1, at(0), at(9)), ("twice", 2, at(300), at(310)), ("unknown", 3, at(0), at(9)), ("no unit", None, at(0), at(9)), ("no end", 1, at(0), None)]
    got = ma.window_mean(spark.createDataFrame(events, EVENTS), spark.createDataFrame(driver, DRIVER), ["unit"], "event", "ts", "total").collect()
    assert {x.event: x.window_mean for x in got} == pytest.approx(means(events, driver)) and len(got) == len({x.event for x in got})
    assert {"twice", "unknown", "e30"} <= {x.event for x in got}


def test_an_event_is_not_shuffled_hour_by_hour(unsent):  # noqa: F811
    events = [(f"e{k}", k % 3, at(k % 24), at(k % 24 + 600)) for k in range(60)]
    driver = [(u, at(h), 1.0) for u in range(3) for h in range(700)]
    got = ma.window_mean(unsent.createDataFrame(events, EVENTS), unsent.createDataFrame(driver, DRIVER), ["unit"], "event", "ts", "total")
    assert {x.window_mean for x in got.collect()} == {1.0}
    assert shuffled(got) < 3000


def test_intervals_are_made_once_for_the_check(spark):
    out = registry.QUERIES["end_mismatch_check"](spark, "/root/testdata/sf0.001")
    assert "l_extendedprice" not in out._jdf.queryExecution().executedPlan().toString()
