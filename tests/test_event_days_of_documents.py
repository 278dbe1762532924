from datetime import datetime, timedelta

from hourloom.operators import documents as dc
from hourloom.operators import timeline as tl

TZ = "Europe/Stockholm"
BODY = ["event_id", "day"]


def data(spark):
    t = datetime(2025, 3, 28, 9)  # the clock changes on the 30th
    events = [(f"E{k}", f"m{k % 3}", t + timedelta(hours=13 * k), t + timedelta(hours=13 * k + 30 * (k % 4))) for k in range(8)] + [("E9", None, t, t), ("Ex", "m0", t, t - timedelta(days=2))]
    versions = [(f"m{m}", v, t + timedelta(hours=17 * v - 40), None if v == 2 else f" text {m} {v}\n") for m in range(2) for v in range(6)]
    return (spark.createDataFrame(events, "event_id string, message string, start timestamp, end timestamp"),
            spark.createDataFrame(versions, "message string, version int, published timestamp, body string"))


def exchanged(df):
    """The columns that are shuffled."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_events_meet_versions_before_days(spark):
    events, versions = data(spark)
    days = tl.event_days(events, "start", "end", TZ).select("event_id", "message", "day")
    columns = ["event_id", "day", "message", "version", "published"]
    old = dc.asof_document_set(days, versions, "message", TZ).select(*columns)
    new = dc.asof_event_documents(events, versions, "message", TZ, "start", "end").select(*columns)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect())) and new.count() > 20


def test_contexts_of_threads_are_those_of_event_days_and_need_no_group_of_them(spark):
    events, versions = data(spark)
    days = tl.event_days(events, "start", "end", TZ).select("event_id", "message", "day")
    old = dc.assemble_context(dc.asof_document_set(days, versions, "message", TZ), BODY, "published", "version", "body")
    new = dc.event_day_contexts(events, versions, "message", TZ, "event_id", "start", "end", "published", "version", "body")
    columns = [*BODY, "context", "n_documents"]
    assert sorted(map(tuple, new.select(*columns).collect())) == sorted(map(tuple, old.select(*columns).collect())) and new.count() > 5
    assert not any("day#" in line for line in exchanged(new)) and any("day#" in line for line in exchanged(old))
