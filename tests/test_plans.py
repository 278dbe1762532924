from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from hourloom.operators import metrics as mt
from hourloom.plans import backtest as bt
from hourloom.plans import curate as cu
from hourloom.plans import hourly_table as ht
from hourloom.streaming.hourly import hourly_mean_stream

TZ = "Europe/Stockholm"
OUT = "mrid string, revision int, docstatus string, unit string, start timestamp, end timestamp, nominal double, avail double, plant_type string"


def test_hourly_table(spark):
    t = datetime(2024, 3, 30, 23)
    feed_a = spark.createDataFrame([("a1", 1, None, "R4", t, t + timedelta(hours=5), 1000.0, 300.0, "Nuclear"), ("a2", 1, "Active", "R5", t, t + timedelta(hours=2), 500.0, 0.0, "Hydro"), ("a2", 2, "Cancelled", "R5", t, t + timedelta(hours=2), 500.0, 0.0, "Hydro")], OUT)
    feed_b = spark.createDataFrame([("b1", 1, None, "R4", t + timedelta(hours=4), t + timedelta(hours=9), 1000.0, 0.0, "Nuclear"), ("b2", 1, None, "R4", t + timedelta(hours=5), t + timedelta(hours=6), 1000.0, 900.0, "Nuclear")], OUT)
    tx = spark.createDataFrame([("x", 1, None, "fi_se3", t, t + timedelta(hours=3), 800.0), ("y", 1, None, "fi_se3", t + timedelta(hours=1), t + timedelta(hours=2), 200.0)], "mrid string, revision int, docstatus string, pair string, start timestamp, end timestamp, avail double")
    series = spark.createDataFrame([("price", t + timedelta(minutes=15 * i), float(i)) for i in range(8)] + [("solar", t + timedelta(hours=3), 5.0)], "series string, ts timestamp, value double")
    slow = spark.createDataFrame([(t - timedelta(days=3), 0.5)], "ts timestamp, value double")
    reg = spark.createDataFrame([("R4", 2024, 1000.0), ("R5", 2024, 500.0), ("tiny", 2024, 50.0)], "unit string, year int, mw double")
    bounds = spark.createDataFrame([(datetime(2024, 3, 31), datetime(2024, 4, 1))], "start timestamp, end timestamp")
    out = ht.build_hourly_table(series, ["price", "solar"], slow, ht.merged_outages(feed_a, feed_b), reg, tx, bounds, ["fi_se3", "se3_fi"], ["fi_se3"], TZ, ["solar"])
    rows = out.orderBy("ts").collect()
    assert len(rows) == 23 and [r.local_hour for r in rows[:3]] == [0, 1, 3]
    assert [r.price for r in rows[:3]] == [1.5, 5.5, None] and [r.solar for r in rows[:5]] == [0.0, 0.0, 0.0, 5.0, None]
    assert [r.unavail_mw for r in rows[:7]] == [700, 700, 700, 700, 700, 100, 0] and rows[0].avail_gen_mw == 800
    assert [r.unavail_tx_fi_se3_mw for r in rows[:4]] == [0, 600, 0, 0] and rows[1].unavail_tx_import_mw == 600 and rows[1].unavail_tx_se3_fi_mw == 0
    assert rows[9].reservoir_fill == 0.5
    cover = {r.column: r for r in ht.table_coverage(out).collect()}
    assert cover["price"].n_present == 2 and cover["price"].longest_run == 21


def test_curation(spark):
    t = datetime(2024, 1, 10)
    cand = spark.createDataFrame([(f"r{i}", f"u{i % 4}", t + timedelta(days=9 * i), t + timedelta(days=9 * i + 3), 300.0 + i, "generation", cu.PLANNED if i % 3 == 0 else cu.UNPLANNED) for i in range(16)] + [("dup", "u1", t + timedelta(days=10), t + timedelta(days=12), 1.0, "generation", cu.UNPLANNED)],
                                 "row_id string, unit string, start timestamp, end timestamp, reduction double, kind string, businesstype string")
    per = [(i, v, f"u{i % 4}", t + timedelta(days=9 * i - 8 + v), "x", t + timedelta(days=9 * i), t + timedelta(days=9 * i + 2 + v), 100.0) for i in range(15) for v in (1, 2)]
    periods = spark.createDataFrame(per, "message int, version int, unit string, published timestamp, remarks string, start timestamp, end timestamp, mw double")
    labelled = cu.label_candidates(cand, "G", TZ)
    rows = cu.match_threads(labelled, periods, ["u3"])
    got = {r.row_id: r for r in rows.collect()}
    assert got["dup"].reason == f"duplicate_of_{got['r1'].event_id}" and got["r3"].reason == "excluded_unit" and got["r1"].accepted
    assert got["r1"].surprise and got["r1"].lead_hours == 7 * 24
    sel = cu.select_events(rows.where("accepted"), 2, 1).collect()
    assert len(sel) == len({r.event_id for r in sel}) and max(sum(s.unit == r.unit for s in sel) for r in sel) <= cu.PER_UNIT_CAP
    assert any(r.flood for r in sel)


def test_backtest_learns_a_daily_pattern(spark):
    rng = np.random.default_rng(0)
    start = datetime(2024, 1, 1, 23)
    rows = []
    for i in range(24 * 45):
        ts = start + timedelta(hours=i)
        wind, avail = float(rng.normal(100, 20)), 1000.0 + 50 * np.sin(i / 50)
        rows += [("z", "wind", ts, wind), ("z", "avail", ts, float(avail)), ("z", "hydro", ts, 0.5), ("z", "price", ts, float(200 - 1.5 * wind + 10 * np.sin(i * np.pi / 12) + rng.normal()))]
    hourly = spark.createDataFrame(rows, "zone string, series string, ts timestamp, value double")
    days = spark.createDataFrame([("z", date(2024, 2, 10) + timedelta(days=k)) for k in range(4)], "zone string, day date")
    fcst, models = bt.backtest(hourly, ["zone"], "price", ["wind", "avail"], "hydro", ["avail"], days, TZ, 30, every=2, burn_in=2, last=5)
    score = mt.mae_rmae(fcst, ["zone"], "y", "point", ["naive"]).first()
    assert score.n_obs == 96 and score.rmae_vs_naive < 0.5
    assert models.select("refit_day").distinct().count() == 2
    assert bt.choose_window({30: fcst, 60: fcst.withColumn("point", F.lit(0.0))}).first().window == 30


def test_stream_gives_the_batch_means(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, h, m), float(h + m)) for h in range(5) for m in (0, 30)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = hourly_mean_stream(stream, ["series"], "ts", "value").writeStream.format("memory").queryName("hm").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.ts.hour: r.value for r in spark.table("hm").collect()}
    assert got == {h: h + 15.0 for h in range(5)}
