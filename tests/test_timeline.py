from datetime import date, datetime

from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import features as ft
from hourloom.operators import running
from hourloom.operators import timeline as tl
from hourloom.sources import readers as rd

TZ = "Europe/Stockholm"


def test_switch_days_have_23_and_25_hours(spark):
    b = spark.createDataFrame([("2024-03-30", "2024-04-01"), ("2024-10-26", "2024-10-28")], "a string, b string")
    b = b.select(F.col("a").alias("k"), F.col("a").cast("timestamp").alias("start"), F.col("b").cast("timestamp").alias("end"))
    h = tl.hour_spine(b, "start", "end", TZ)
    n = {str(r[0]): r[1] for r in h.groupBy(cal.local_day(F.col("ts"), TZ)).count().collect()}
    assert n == {"2024-03-30": 24, "2024-03-31": 23, "2024-10-26": 24, "2024-10-27": 25}


def test_hour_label_skipped_and_repeated(spark):
    df = spark.createDataFrame([(date(2024, 3, 31), 2), (date(2024, 3, 31), 3), (date(2024, 10, 27), 2), (date(2024, 10, 27), 3)], "d date, h int")
    got = [r[0] for r in df.select(cal.hour_label(F.col("d"), F.col("h"), TZ)).collect()]
    assert got == [None, datetime(2024, 3, 31, 1), datetime(2024, 10, 27, 0), datetime(2024, 10, 27, 2)]


def test_profile_keeps_first_of_repeated_hour_and_hour_23(spark):
    b = spark.createDataFrame([(datetime(2024, 10, 27), datetime(2024, 10, 28))], "start timestamp, end timestamp")
    h = tl.hour_spine(b, "start", "end", TZ).withColumn("v", F.unix_seconds("ts").cast("double"))
    p = {r.hour: r.v for r in ft.day_hour_profile(h, [], "ts", "v", TZ).collect()}
    assert len(p) == 24 and p[23] is not None
    assert p[2] == datetime(2024, 10, 27, 0).timestamp() - datetime(1970, 1, 1).timestamp()


def test_gate_is_calendar_noon_before(spark):
    df = spark.createDataFrame([(date(2024, 4, 1),), (date(2025, 2, 6),)], "d date")
    assert [r[0] for r in df.select(cal.gate_time(F.col("d"), TZ)).collect()] == [datetime(2024, 3, 31, 10), datetime(2025, 2, 5, 11)]


def test_mixed_offsets_and_seven_digit_fractions(spark):
    df = spark.createDataFrame([("2025-09-15 00:00:00+02:00", "2025-02-04T08:25:11.1234567Z"), ("n/a", "2025-02-04T08:25:11")], "a string, b string")
    got = df.select(rd.parse_offset_timestamp(F.col("a")), rd.parse_iso_utc(F.col("b"))).collect()
    assert got[0] == (datetime(2025, 9, 14, 22), datetime(2025, 2, 4, 8, 25, 11, 123456))
    assert got[1] == (None, datetime(2025, 2, 4, 8, 25, 11))


def test_fills_cross_bucket_borders(spark):
    rows = [("a", datetime(2024, m, 1), v) for m, v in zip(range(1, 8), [None, 1.0, None, None, 4.0, None, None])]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    f = running.carry_forward(df, ["k"], "ts", {"v": "f"}, "month")
    b = running.carry_forward(f, ["k"], "ts", {"v": "b"}, "month", backward=True).orderBy("ts").collect()
    assert [r.f for r in b] == [None, 1, 1, 1, 4, 4, 4]
    assert [r.b for r in b] == [1, 1, 4, 4, 4, None, None]


def test_coverage_first_longest_run_wins(spark):
    vals = [1.0, None, None, 2.0, None, None, 3.0]
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, i), v) for i, v in enumerate(vals)], "k string, ts timestamp, v double")
    r = tl.coverage_report(df, ["k"], "ts", "v").first()
    assert (r.n_expected, r.n_present, r.longest_run, r.longest_start, r.longest_end) == (7, 3, 2, datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2))


def test_exact_quantiles_refine_bins(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = {"a": rng.lognormal(size=500), "b": np.round(rng.normal(size=301), 1), "c": np.array([5.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "k string, v double")
    got = {(r.k, r.p): r.q for r in running.exact_quantiles(df, ["k"], "v", [0.05, 0.5, 0.99], bins=7, max_bin=5).collect()}
    for (k, p), q in got.items():
        assert abs(q - np.quantile(data[k], p)) < 1e-12
    assert len(got) == 9


def test_global_positions_number_everything_once(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("x"))
    got = running.global_positions(df, ["x"]).collect()
    assert all(r.x == r.pos for r in got) and len(got) == 1000
