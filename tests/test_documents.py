import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hourloom.functions import text as tx
from hourloom.operators import documents as dc
from hourloom.operators import matching as ma
from hourloom.operators import selection as se
from hourloom.sources import readers as rd
from hourloom.sources import sinks as sk

TZ = "Europe/Stockholm"


def test_only_versions_published_by_the_gate_are_visible(spark):
    pubs = ["2025-02-04 08:25:00", "2025-02-05 08:08:00", "2025-02-07 02:27:00", "2025-02-07 13:48:00", "2025-02-08 01:43:00"]
    v = spark.createDataFrame([("m", i + 1, datetime.fromisoformat(p), f"text {i + 1}") for i, p in enumerate(pubs)], "message string, version int, published timestamp, body string")
    days = spark.createDataFrame([("E", "m", date(2025, 2, 6)), ("E", "m", date(2025, 2, 4))], "event_id string, message string, day date")
    seen = dc.asof_document_set(days, v, "message", TZ)
    assert sorted((str(r.day), r.version) for r in seen.collect()) == [("2025-02-06", 1), ("2025-02-06", 2)]
    ctx = dc.assemble_context(seen, ["event_id", "day"], "published", "version", "body").first().context
    assert ctx == "--- version 1 | published 2025-02-04 08:25:00 ---\ntext 1\n\n--- version 2 | published 2025-02-05 08:08:00 ---\ntext 2"


def test_nested_messages_and_absent_periods(spark, tmp_path):
    (tmp_path / "a.json").write_text("""[{"messageId": "m1", "version": 2, "publicationDate": "2025-02-04T08:25:11.1234567Z", "remarks": null,
      "productionUnits": [{"name": "U1", "eic": "X", "timePeriods": [{"eventStart": "2025-02-05T00:00:00Z", "eventStop": "2025-02-06T00:00:00Z", "unavailableCapacity": 300, "availableCapacity": 10},
      {"eventStart": "2025-02-08T00:00:00Z", "eventStop": "2025-02-09T00:00:00Z"}]}, {"name": "U2", "eic": "Y"}],
      "transmissionUnits": [{"name": "T", "inAreaEic": "A", "outAreaEic": "B", "timePeriods": []}]}]""")
    rows = rd.explode_messages(rd.scan_messages(spark, str(tmp_path))).collect()
    assert len(rows) == 4 and [r.mw for r in rows if r.unit == "X"] == [300.0, None]
    assert all(r.start is not None for r in rows if r.unit == "X") and all(r.start is None for r in rows if r.unit != "X")
    assert {(r.kind, r.unit) for r in rows} == {("generation", "X"), ("generation", "Y"), ("transmission", "A>B")}
    rec = dc.version_record(rd.explode_messages(rd.scan_messages(spark, str(tmp_path))), ["messageId", "version", "unit"], "start", "end", "mw")
    x = {r.unit: r for r in rec.collect()}
    assert x["X"].end == datetime(2025, 2, 9) and x["X"].mw == 300.0 and x["Y"].start is None


def test_revision_surprise_skips_versions_without_bounds(spark):
    t = datetime(2025, 1, 1)
    rows = [("a", 1, t, 100.0), ("a", 2, None, None), ("a", 3, t + timedelta(hours=6), 200.0), ("b", 1, t, 100.0), ("b", 2, None, None), ("b", 3, t + timedelta(hours=6, seconds=1), 100.0), ("c", 1, t, 5.0), ("c", 2, t, 105.5)]
    got = dc.revision_surprise(spark.createDataFrame(rows, "m string, version int, end timestamp, mw double"), ["m"], "version", "end", "mw", bucket=2)
    assert {r.m: r.surprise for r in got.collect()} == {"a": False, "b": True, "c": True}


def test_best_thread_takes_nearest_first_publication(spark):
    t = datetime(2025, 1, 10)
    cand = spark.createDataFrame([("c", "u", t, t + timedelta(days=2))], "cand string, unit string, start timestamp, end timestamp")
    per = [("old", 1, t - timedelta(days=30), t, t + timedelta(days=2)), ("long", 1, t, t, t + timedelta(days=7)), ("near", 2, t + timedelta(days=3), t, t + timedelta(days=2)), ("near", 1, t - timedelta(hours=5), t + timedelta(days=9), t + timedelta(days=10))]
    p = spark.createDataFrame(per, "thread string, version int, published timestamp, start timestamp, end timestamp").withColumn("unit", F.lit("u"))
    threads = ma.latest_version(p, ["thread"], "version")
    pairs, report = ma.interval_overlap_match(cand, threads, "unit", "cand", "thread", [])
    assert report.first().n_matched == 3
    best = ma.best_thread_argmin(pairs, p, "cand", "thread", "version", "published").first()
    assert best.thread == "near" and best.n_passed == 2


def test_effect_rules(spark):
    good = '{"reasoning": "r", "p_active": 1, "start_hour": {"mean": 0, "sd": 0}, "end_hour": {"mean": 24, "sd": 12}, "size_mw": {"p10": 1, "p50": 1, "p90": 2}, "direction": "none"}'
    cases = [(good, None), (good.replace('"p_active": 1', '"p_active": 1.5'), "invalid p_active"), (good.replace('"sd": 12', '"sd": 13'), "invalid end_hour"), (good.replace('"p90": 2', '"p90": 0'), "invalid size_mw"),
             (good.replace('"r"', '" "'), "empty reasoning"), (good.replace("none", "up"), "invalid direction"), (good.replace('"sd": 0}', '"sd": 0, "x": 1}'), "invalid start_hour"), ("nonsense", "unexpected keys")]
    got = dc.validate_effect(spark.createDataFrame([(c[0],) for c in cases], "j string"), "j").collect()
    assert [r.reason for r in got] == [c[1] for c in cases]


def test_language_and_redaction(spark):
    df = spark.createDataFrame([("Fel på turbin",), ("Reduced due to work on the line.",), ("",), (None,), ("xyz",), ("vid och the",)], "t string")
    got = [r.x for r in df.select(tx.language_label(F.col("t")).alias("x")).collect()]
    assert [(x.label, x.ambiguous) for x in got] == [("foreign", False), ("english", False), ("empty", False), ("empty", False), ("english", True), ("foreign", False)]
    assert spark.range(1).select(tx.redact_token(F.lit("u?SECURITYTOKEN=abc&x=1"))).first()[0] == "u?SECURITYTOKEN=***REDACTED***&x=1"


def swapped(rows, start, quota, cap):
    """The rule one candidate after the other."""
    chosen, n = list(start), sum(bool(r[5]) for r in start)
    taken = {r[0] for r in start}
    for r in sorted((r for r in rows if r[5] and r[0] not in taken), key=lambda r: (-r[2], r[0])):
        if n >= quota:
            break
        if r[3] == "generation" and sum(s[1] == r[1] for s in chosen) >= cap:
            continue
        same = [s for s in chosen if s[3] == r[3] and s[4] == r[4] and not s[5]]
        if same:
            chosen.remove(min(same, key=lambda s: (s[2], s[0])))
            chosen.append(r)
            n += 1
    return {c[0] for c in chosen}


@pytest.mark.parametrize(("seed", "units", "n", "quota"), [(7, 5, 60, 4), (8, 2, 200, 6), (9, 30, 120, 9), (10, 3, 150, 50)])
def test_swap_of_same_kind_matches_sequential_rule(spark, seed, units, n, quota):
    rng = random.Random(seed)
    rows = [(f"r{i:03d}", None if rng.random() < 0.05 else f"u{rng.randrange(units)}", float(rng.randrange(100)), rng.choice(["generation", "transmission"]), rng.choice(["A", "B", None]), rng.choice([True, False, False, None])) for i in range(n)]
    pool = spark.createDataFrame(rows, "id string, unit string, size double, kind string, business string, flood boolean")
    start = sorted([r for r in rows if not r[5]], key=lambda r: (-r[2], r[0]))[:9]
    selected = spark.createDataFrame(start, pool.schema)
    got = se.topk_swap_same_kind(pool, selected, F.col("flood"), quota, "id", "unit", "size", ["kind", "business"], F.col("kind") == "generation", 3)
    assert {r.id for r in got.collect()} == swapped(rows, start, quota, 3)


def test_swap_reads_on_when_a_unit_gets_below_its_cap(spark):
    """u is at its cap and all its candidates on the first list are passed over; then one of its picks is replaced."""
    rows = [(f"a{i}", "u", 500.0 - i, "generation", "A", False) for i in range(3)] + [("w", "v", 600.0, "generation", "B", False)]
    rows += [(f"c{i:03d}", "u", 400.0 - i, "generation", "B", True) for i in range(100)] + [("x", "y", 350.5, "generation", "A", True), ("z", "y", 320.5, "generation", "A", True)]
    pool = spark.createDataFrame(rows, "id string, unit string, size double, kind string, business string, flood boolean")
    selected = spark.createDataFrame(rows[:4], pool.schema)
    got = se.topk_swap_same_kind(pool, selected, F.col("flood"), 3, "id", "unit", "size", ["kind", "business"], F.col("kind") == "generation", 3)
    assert {r.id for r in got.collect()} == swapped(rows, rows[:4], 3, 3) == {"a0", "x", "c050", "z"}


def test_resume_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 2) for i in range(5)], "k int, v int")
    for _ in range(2):
        sk.resume_append(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    sk.replace_snapshot(df.where("k < 2"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
