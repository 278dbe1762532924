"""only candidates that may meet a thread are shuffled for it, and intervals are made once."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hourloom.operators import matching as ma
from hourloom.operators import relations as rel
from hourloom.sources import sinks as sk
from testbed import registry
from testbed.bindings import documents  # noqa: F401  (registers the queries)

T0 = datetime(2024, 1, 1)
day = lambda d: T0 + timedelta(days=d)
THREADS = "message string, unit long, start timestamp, end timestamp"


@pytest.fixture
def unsent(spark):
    """Only what the operators ask for is sent to every task."""
    asked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", asked)


def shuffled(df) -> int:
    """Rows written to shuffles by a frame that has been collected."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind != "ReusedExchangeExec":
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo.extend(node.children().apply(k) for k in range(node.children().size()))
    return total


def test_candidates_that_meet_no_thread_are_not_shuffled(unsent):
    rows = [(f"r{k}", k % 50, day(k * 37 % 701), day(k * 37 % 701 + 5)) for k in range(4000)]
    threads = [("m1", 7, day(100), day(109)), ("m2", 7, day(102), day(104)), ("m3", 9, None, None), ("m4", 11, day(690), day(720)), ("m5", 11, day(0), day(3))]
    candidates = unsent.createDataFrame(rows, "row string, unit int, start timestamp, end timestamp")  # units are compared as longs
    _, report = ma.interval_overlap_match(candidates, unsent.createDataFrame(threads, THREADS), "unit", "row", "message", [])
    got = {r.row: (r.n_matched, r.first_match, r.reason) for r in report.collect()}

    def expected(row):
        _, unit, a, z = row
        met = [m for m, u, b, y in threads if u == unit and b and (min(z, y) - max(a, b)) / min(z - a, y - b) >= 0.5]
        return len(met), min(met, default=None), None if met else "overlap_below_50pct" if unit in (7, 9, 11) else "unit_not_pulled"

    assert got == {r[0]: expected(r) for r in rows} and sum(n for n, *_ in got.values()) >= 2
    assert shuffled(report) < 500


def test_a_candidate_that_comes_twice_counts_the_matches_of_all_its_rows(spark):
    rows = [("a", 1, day(0), day(4)), ("a", 1, day(0), day(4)), ("a", 2, day(300), day(301)), ("b", 1, day(200), day(201)), (None, 1, day(0), day(4)), ("c", None, day(0), day(4)), ("d", 1, None, day(4))]
    candidates = spark.createDataFrame(rows, "row string, unit long, start timestamp, end timestamp")
    threads = spark.createDataFrame([("m2", 1, day(0), day(4)), ("m1", 1, day(1), day(3))], THREADS)
    _, report = ma.interval_overlap_match(candidates, threads, "unit", "row", "message", [])
    assert Counter((r.row, r.unit, r.n_matched, r.first_match, r.reason) for r in report.collect()) == Counter([
        ("a", 1, 4, "m1", None), ("a", 1, 4, "m1", None), ("a", 2, 4, "m1", None), ("b", 1, 0, None, "overlap_below_50pct"), (None, 1, 0, None, "overlap_below_50pct"),
        ("c", None, 0, None, "unit_not_pulled"), ("d", 1, 0, None, "overlap_below_50pct")])


def test_marks_miss_no_key(spark, monkeypatch):
    monkeypatch.setattr(rel, "PLACES", 1 << 10)
    df = spark.range(500).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") != 3, F.col("id") % 7).alias("j"))
    other = spark.range(0, 500, 25).select(F.col("id").alias("k"), F.when(F.col("id") != 25, F.col("id") % 7).alias("j"))
    marked = {r.k for r in rel.mark_possible(df, other, ["k", "j"], "may").where("may").collect()}
    assert set(range(0, 500, 25)) - {25} <= marked and len(marked) < 60
    assert rel.mark_possible(df, other.limit(0), ["k", "j"], "may").where("may").count() == 0


def test_a_frame_made_once_keeps_all_values(spark):
    df = spark.createDataFrame([("a", datetime(1583, 1, 2, 3, 4, 5, 6), 1.5), (None, None, None), ("b", datetime(9999, 12, 31), float("nan"))], "s string, t timestamp, x double")
    assert sorted(map(str, sk.made_once(df).collect())) == sorted(map(str, df.collect()))


def test_intervals_are_made_once_for_the_match(spark):
    report = registry.QUERIES["interval_overlap_match"](spark, "/root/testdata/sf0.001")
    assert "l_extendedprice" not in report._jdf.queryExecution().executedPlan().toString()
