import random

import pytest
from pyspark.sql import functions as F

from hourloom.operators import selection as se

SCHEMA = "id string, unit int, size double, season string"


def brute(rows, strata):
    """Strata in order, each by one pass over its rows from the largest."""
    picked = []
    for mask, n, cap in strata:
        got = 0
        for r in sorted((r for r in rows if mask(r) and r not in picked), key=lambda r: (-r[2], r[0])):
            if got < n and (cap is None or sum(p[1] == r[1] for p in picked) < cap):
                picked.append(r)
                got += 1
    return sorted(picked)


@pytest.mark.parametrize("seed", range(3))
def test_strata_of_one_short_list_are_those_of_the_whole_pool(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{k:03d}", rng.randrange(6 + 6 * seed), float(rng.randrange(8)), rng.choice("abc") if k % 9 else None) for k in range(200)]
    rng.shuffle(rows)
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    pool = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), SCHEMA)
    plain = [(lambda r: r[3] == "a", 5, 2), (lambda r: r[3] == "b", 7, 1), (lambda r: r[2] > 2, 6, None), (lambda r: True, 9, 3), (lambda r: r[3] == "c", 0, 3)]
    masks = [F.col("season") == "a", F.col("season") == "b", F.col("size") > 2, F.lit(True), F.col("season") == "c"]
    got = se.topk_per_stratum_capped(pool, [(m, n, cap) for m, (_, n, cap) in zip(masks, plain, strict=True)], "id", "unit", "size")
    assert sorted(map(tuple, got.collect())) == brute(rows, plain)
    assert read.value <= 2 * len(rows)  # once for strata with a cap, once for those without


def test_a_pool_with_caps_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(k):
        read.add(1)
        return (f"r{k}", k % 10, float(k), "ab"[k % 2])

    pool = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 3).map(seen), SCHEMA)
    got = se.topk_per_stratum_capped(pool, [(F.col("season") == "a", 4, 2), (F.col("season") == "b", 4, 2), (F.lit(True), 4, 2)], "id", "unit", "size")
    assert got.count() == 12 and read.value == 100
