"""Cases off the usual path: instants inside the hour, long chains, infinite values, NULL keys."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourloom.functions import lasso
from hourloom.operators import documents, intervals, running
from hourloom.session import ensure_checkpoint_dir
from hourloom.sources import sinks

T0 = datetime(2024, 1, 1)
SCHEMA = "unit string, id long, start timestamp, end timestamp, size double"


def sequential(rows):
    """Largest first, smaller id on ties: id -> id of the largest kept row it overlaps."""
    kept, out = [], {}
    for _, i, a, z, s in sorted(rows, key=lambda r: (-r[4], r[1])):
        hit = next((k for k, b, e in kept if a < e and b < z), None)
        out[i] = hit
        if hit is None:
            kept.append((i, a, z))
    return out


def check_greedy(spark, rows, **options):
    got = intervals.greedy_interval_dedup(spark.createDataFrame(rows, SCHEMA), ["unit"], "id", "start", "end", "size", **options)
    assert {r["id"]: r["duplicate_of"] for r in got.collect()} == sequential(rows)


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_greedy_chain_and_many_disjoint_rows(spark):
    chain = [("u", i, minutes(10 * i), minutes(10 * i + 15), float(5000 - i)) for i in range(3000)]
    check_greedy(spark, chain)
    disjoint = [("u", i, minutes(i), minutes(i + 1), float(i % 7)) for i in range(20_000)]
    got = intervals.greedy_interval_dedup(spark.createDataFrame(disjoint, SCHEMA), ["unit"], "id", "start", "end", "size")
    assert got.count() == 20_000 and got.where("duplicate_of is not null").isEmpty()


@pytest.mark.parametrize("fold_rows", [7, 1000])
def test_greedy_equals_the_sequential_rule(spark, fold_rows):
    r = random.Random(fold_rows)
    rows = []
    for i in range(150):
        a = r.randrange(4000)
        rows.append((r.choice("uv"), i, minutes(a), minutes(a + r.randrange(1, 300)), float(r.randrange(9))))
    both = {k: v for u in "uv" for k, v in sequential([x for x in rows if x[0] == u]).items()}
    got = intervals.greedy_interval_dedup(spark.createDataFrame(rows, SCHEMA), ["unit"], "id", "start", "end", "size", fold_rows=fold_rows)
    assert {x["id"]: x["duplicate_of"] for x in got.collect()} == both


@pytest.mark.parametrize(("step", "offset"), [(15, 0), (60, 30), (60, 45)])
def test_sums_and_minima_at_any_instant(spark, step, offset):
    r = random.Random(step + offset)
    rows = []
    for i in range(60):
        a = r.randrange(3000)
        rows.append(("u", i, minutes(a), minutes(a + r.randrange(1, 700)), float(r.randrange(1, 50))))
    points = [minutes(offset + step * k) for k in range(3000 // step)]
    spine = spark.createDataFrame([("u", p) for p in points], "unit string, ts timestamp")
    df = spark.createDataFrame(rows, SCHEMA)
    total = {x["ts"]: x["total"] for x in intervals.sweep_line_sum(df, ["unit"], "start", "end", "size", spine).collect()}
    low = {x["ts"]: x["min_active"] for x in intervals.min_active_value(df, ["unit"], "start", "end", "size", spine).collect()}
    for p in points:
        active = [x[4] for x in rows if x[2] <= p < x[3]]
        assert total[p] == sum(active) and low[p] == min(active, default=None)


def test_quantiles_leave_out_what_is_not_finite(spark):
    values = [float(i) for i in range(50)] + [float("inf"), float("-inf"), float("nan"), None, 1.7e308, -1.7e308]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {x["p"]: x["q"] for x in running.exact_quantiles(df, ["g"], "v", [0.25, 0.5], bins=4, max_bin=5).collect()}
    finite = np.array([v for v in values if v is not None and np.isfinite(v)])
    assert got[0.5] == np.quantile(finite, 0.5) and got[0.25] == np.quantile(finite, 0.25)


def test_append_again_adds_nothing(spark, tmp_path):
    todo = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (1, "d")], "k long, v string")
    for _ in range(3):
        sinks.resume_append(todo, str(tmp_path / "sink"), ["k"])
    assert sorted((r["k"] is None for r in spark.read.parquet(str(tmp_path / "sink")).collect())) == [False, True]


def test_cached_twice_and_blank_lines(spark):
    cache = spark.createDataFrame([("q", "z"), ("q", "b"), ("r", None)], "k string, answer string")
    hit = documents.cache_lookup(spark.createDataFrame([("q",), ("r",), ("s",)], "k string"), cache, "k").collect()
    assert {(r["k"], r["answer"], r["cache_hit"]) for r in hit} == {("q", "b", True), ("r", None, True), ("s", None, False)}


def test_noise_variance_equals_the_residual_of_the_fit():
    rng = np.random.default_rng(0)
    for n, p in ((80, 6), (12, 30)):
        x, y = rng.normal(size=(n, p)), rng.normal(size=(n, 3))
        x, y = x - x.mean(axis=0), y - y.mean(axis=0)
        got = lasso.noise_variance(x.T @ x / n, x.T @ y / n, (y**2).sum(axis=0), n)
        if n > p + 1:
            rest, used = y - x @ np.linalg.lstsq(x, y, rcond=None)[0], p + 1
        else:
            penalty = np.trace(x.T @ x) / min(n, p)
            hat = x @ np.linalg.solve(x.T @ x + penalty * np.eye(p), x.T)
            rest, used = y - hat @ y, np.trace(hat)
        assert np.allclose(got, (rest**2).sum(axis=0) / (n - used))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Stub:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        ensure_checkpoint_dir(Stub)


def test_one_key_spreads_over_its_buckets(spark):
    line = spark.range(2000).select(F.lit("u").alias("k"), F.timestamp_seconds(F.col("id") * 86_400).alias("ts"), F.col("id").cast("double").alias("x"))
    got = running.running_max_before(line, ["k"], "ts", "x", "before")
    assert got.where("before = x - 1").count() == 1999 and got.where("before is null").count() == 1


def test_one_island_is_ranked_by_many_tasks(spark):
    """One key whose rows all hang together: the ranking is dealt by size over range partitions, and the largest rows are the right ones."""
    rows = [("u", i, minutes(10 * i), minutes(10 * i + 15), None if i % 97 == 0 else float((i * 7919) % 500)) for i in range(2000)] + [("v", 9000, minutes(0), minutes(1), 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        islands = intervals._sized(intervals._islands(df, ["unit"], "start", "end"), ["unit"])
        top = intervals._largest(islands, ["unit"], "id", "size", 700)
        got = top.where("unit = 'u'").withColumn("task", F.spark_partition_id()).collect()
        placed = running.global_positions(islands.withColumn("less", -F.col("size")), ["unit", "less", "id"], "at")
        tasks = placed.where("unit = 'u'").select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    best = sorted((r for r in rows if r[0] == "u"), key=lambda r: (r[4] is None, -(r[4] or 0), r[1]))[:700]
    assert {r["id"] for r in got} == {r[1] for r in best} and tasks > 1
    assert [r["id"] for r in top.where("unit = 'v'").collect()] == [9000]


def test_bootstrap_beyond_local_values_makes_no_row_for_a_slot_of_a_draw(spark, monkeypatch):
    from hourloom.operators import inference

    monkeypatch.setattr(inference, "SLOT_BLOCK", 16)
    r = random.Random(4)
    rows = [(g, f"e{i:03d}", None if i % 11 == 0 else r.uniform(-2, 3)) for g, n in (("a", 50), ("b", 16), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, e string, v double")
    near = {x["g"]: x for x in inference.block_bootstrap(df, ["g"], "e", "v", draws=60).collect()}
    far_frame = inference.block_bootstrap(df, ["g"], "e", "v", draws=60, local_values=0)
    far = {x["g"]: x for x in far_frame.collect()}
    assert set(near) == set(far) == {"a", "b", "c"}
    for g in near:
        for c in ("n_events", "estimate", "ci_low", "ci_high", "p_below_zero"):
            assert near[g][c] == pytest.approx(far[g][c], abs=1e-12) if near[g][c] is not None else far[g][c] is None
    assert "conv(" not in far_frame._jdf.queryExecution().optimizedPlan().toString()
