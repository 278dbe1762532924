"""events are made once for a panel, event-hours are not shuffled to meet hourly tables, no row is sent per counted key."""

from datetime import date, datetime

from pyspark.sql import functions as F

from hourloom.operators import audit
from testbed import views as V
from testbed.bindings import diagnostics

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_are_made_once_and_event_hours_are_not_shuffled(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def row(k):
        made.add(1)
        return (f"{k}", "generation" if k % 2 else "transmission", "error" if k % 2 else "signup", float(k), datetime(2024, 1, 8 + k % 9, 5), datetime(2024, 1, 9 + k % 9, 5))

    events = spark.createDataFrame(
        spark.sparkContext.parallelize(range(60), 2).map(row), "event_id string, kind string, driver string, reduction double, start timestamp, end timestamp")
    monkeypatch.setattr(V, "curated", lambda *_: events)
    panel = diagnostics.panel(spark, FOLDER)
    assert "SortMergeJoin" not in plan(panel)
    rows = panel.count()
    assert rows > 0 and rows % 24 == 0 and made.value == 60


def test_summary_counts_keys_as_before_without_a_row_per_counted_key(spark):
    d = date(2024, 1, 5)
    rows = [("a", d, True, 1.0, 2.0, 2.0), ("a", d, False, None, 2.0, 2.5), ("a", date(2024, 1, 6), True, 1.0, None, 1.0), ("b", d, True, float("nan"), 1.0, 1.0),
            ("b", None, True, 1.0, 1.0, 9.0), (None, d, None, 1.0, 1.0, None)]
    panel = spark.createDataFrame(rows, "event_id string, day date, affected boolean, y double, stored double, baseline double")
    want = panel.agg(F.countDistinct("event_id"), F.countDistinct("event_id", "day")).first()
    out = audit.panel_summary(panel)
    assert "Expand" not in plan(out)
    got = out.first()
    assert (got.n_events, got.n_event_days) == tuple(want) == (2, 3)
    assert tuple(got)[2:] == (6, 4, 2, 5, 2, 8.0)
    assert tuple(audit.panel_summary(panel.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0, None)


def test_event_hours_are_added_up_per_event_day_before_panel_and_paths_meet(spark, monkeypatch):
    monkeypatch.setattr(V, "curated", lambda *_: spark.range(60).selectExpr(
        "CAST(id AS STRING) AS event_id", "if(id % 2 = 1, 'generation', 'transmission') AS kind", "if(id % 2 = 1, 'error', 'signup') AS driver", "CAST(id % 7 + 1 AS DOUBLE) AS reduction",
        "timestamp_seconds(1704690000 + id % 9 * 86400) AS start", "timestamp_seconds(1704776400 + id % 9 * 86400) AS end"))
    asked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # only what the operators ask for is sent to every task
        results = diagnostics.audited(spark, FOLDER)
        text = plan(results)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)
    dealt = [x for x in text.splitlines() if "hashpartitioning(" in x]
    assert dealt and not any("hour" in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt)
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text
    assert {r["check"] for r in audit.audit_invariants(results).collect()} >= {"generation_sign", "transmission_sign"}
