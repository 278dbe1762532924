"""Findings of round 3: joins by keys of few values, and tables that were made once per use."""

from pyspark.sql import functions as F

from hourloom.operators import inference
from hourloom.operators import relations as rel
from testbed import registry
from testbed import views as V
from testbed.bindings import files

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_does_not_shuffle_rows_by_a_group_of_few_values(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("kind"), (-F.col("id")).alias("at"))
    expected = sorted((str(k), -(3 * i + k), f"{k}{1000 - i:03d}") for k in range(3) for i in range(1000))
    for most in (inference.LOCAL_GROUPS, 0):
        monkeypatch.setattr(inference, "LOCAL_GROUPS", most)
        out = rel.positional_ids(rows, "kind", ["at"], "event_id")
        joined = [line for line in plan(out).splitlines() if "Join" in line]
        assert not any("[kind#" in line and "__part" not in line for line in joined)
        assert sorted(map(tuple, out.collect())) == expected


def test_the_year_map_is_not_met_by_a_shuffle_of_rows_by_year(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [year" not in plan(registry.QUERIES["lookup_year_map"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_table_that_is_written_often_is_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def row(k):
        made.add(1)
        return (f"{k}", "generation" if k % 2 else "transmission", float(k))

    events = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 2).map(row), "event_id string, kind string, reduction double")
    monkeypatch.setattr(V, "curated", lambda *_: events)
    for query, n in ((files.replace_snapshot, 2), (files.resume_append, 100)):
        made.value = 0
        assert query(spark, FOLDER).count() == n and made.value == 100
