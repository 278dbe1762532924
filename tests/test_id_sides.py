"""ids are compared by one aggregate, without a sorted join of them."""

import pytest

from hourloom.operators import relations as rel
from testbed import registry
from testbed.bindings import intervals  # noqa: F401  (registers the queries)

FOLDER = "/root/testdata/sf0.001"


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_only_ids_of_the_third_table_count(spark):
    left, right, among = ids(spark, 1, 1, 2, 3, None), ids(spark, 2, 4, 5, None), ids(spark, 1, 2, 2, 4, 9, None)
    assert tuple(rel.id_set_compare(left, right, "k", among).first()) == (1, 1, 1)
    assert tuple(rel.id_set_compare(left, right, "k").first()) == (2, 2, 1)
    assert tuple(rel.id_set_compare(left, right, "k", among.limit(0)).first()) == (0, 0, 0)
    sides = {r.k: r.side for r in rel.set_sides(left, right, "k", out="k", among=among).collect()}
    assert sides == {1: "left", 2: "both", 4: "right"}


@pytest.mark.parametrize("name", ["id_set_compare", "set_intersect_except"])
def test_ids_are_neither_sorted_nor_joined(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and "Sort " not in plan
