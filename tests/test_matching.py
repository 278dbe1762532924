"""Names against messages, reasons for no match, documents of several units."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hourloom.operators import documents as dc
from hourloom.operators import matching as ma
from hourloom.sources import readers as rd


def first_match(outages, messages):
    """The rule, message after message: {outage: (message, matched)}."""
    spoken = [m for m in messages if m[3]] or messages
    spare = min(spoken, key=lambda m: m[0])[0]
    out = {}
    for o, unit, name in outages:
        needle = (name or "").strip().lower()
        hits = [m[0] for m in messages if (unit is not None and m[1] == unit) or (needle and needle in (m[2] or "").strip().lower())]
        out[o] = (min(hits), True) if hits else (spare, False)
    return out


@pytest.mark.parametrize("remarks", [True, False])
def test_names_are_found_as_message_after_message(spark, remarks):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abc ") for _ in range(n))
    messages = [(i, r.choice([None, 1, 2, 3]), r.choice([None, "Hot Unit", word(8)]), r.choice(["x", "", None]) if remarks else None) for i in range(300)]
    outages = [(i, r.choice([None, None, None, 2, 9]), r.choice([None, "", " ", "zzz", "hot", "UNIT ", word(1), word(2), word(3), word(5)])) for i in range(120)]
    got = ma.unit_name_match(
        spark.createDataFrame(outages, "o int, unit int, name string"), spark.createDataFrame(messages, "m int, unit int, name string, remarks string").withColumn("ord", F.col("m")),
        "o", "m", "ord", "unit", "name", "remarks").collect()
    assert {x.o: (x.m, x.matched) for x in got} == first_match(outages, messages) and len(got) == 120


def test_no_messages_at_all(spark):
    outages = spark.createDataFrame([(1, 2, "a")], "o int, unit int, name string")
    none = spark.createDataFrame([], "m int, unit int, name string, remarks string, ord int")
    assert [tuple(x) for x in ma.unit_name_match(outages, none, "o", "m", "ord", "unit", "name", "remarks").collect()] == [(1, None, False)]


def test_reasons_for_no_match(spark):
    t = lambda d: datetime(2024, 1, d)
    cand = spark.createDataFrame([
        ("a", 1, "generation", t(1), t(5), None), ("b", 1, "generation", t(20), t(22), None), ("c", 2, "generation", t(1), t(5), None), ("d", 2, "transmission", t(1), t(5), None),
        ("e", 3, "transmission", t(1), t(5), None), ("f", 1, "generation", t(1), t(5), "a"), ("g", 9, "generation", t(1), t(5), None)],
        "row string, unit int, kind string, start timestamp, end timestamp, duplicate_of string")
    threads = spark.createDataFrame([("m1", 1, t(2), t(4)), ("m3", 3, None, None), ("m9", 9, t(1), t(5))], "message string, unit int, start timestamp, end timestamp")
    pairs, report = ma.interval_overlap_match(cand, threads, "unit", "row", "message", [9], "duplicate_of", kind="kind")
    assert {r.row: (r.n_matched, r.reason) for r in report.collect()} == {
        "a": (1, None), "b": (0, "overlap_below_50pct"), "c": (0, "unit_not_pulled"), "d": (0, "no_umm_thread"), "e": (0, "overlap_below_50pct"),
        "f": (0, "duplicate_of_a"), "g": (0, "excluded_unit")}
    assert [r.row for r in pairs.collect()] == ["a"]


def test_documents_show_all_units_and_what_is_missing(spark, tmp_path):
    period = {"unavailableCapacity": 10.5, "eventStart": "2024-01-01T00:00:00Z", "eventStop": "2024-01-02T00:00:00Z"}
    messages = [
        {"messageId": "m1", "version": 1, "publicationDate": "2023-12-31T12:00:00Z", "remarks": "two\nlines",
         "productionUnits": [{"name": "A", "eic": "EA", "timePeriods": [period, {"availableCapacity": 3.0}]}, {"name": None, "eic": "EB"}],
         "transmissionUnits": [{"name": "line", "inAreaEic": "X", "outAreaEic": "Y", "timePeriods": []}]},
        {"messageId": "m2", "version": 1, "productionUnits": []}]
    (tmp_path / "x.json").write_text(json.dumps(messages))
    read = rd.scan_messages(spark, str(tmp_path))
    units = rd.message_units(read)
    assert {(r.messageId, r.kind, tuple(u.unit for u in r.units)) for r in units.collect()} == {("m1", "generation", ("EA", "EB")), ("m1", "transmission", ("X>Y",))}
    flat = rd.explode_messages(read)
    assert flat.count() == 4 and {r.unit_name for r in flat.collect()} == {"A", None, "line"}
    blank = lambda name: F.lit(None).cast("string").alias(name)
    v = units.where("kind = 'generation'").select(
        F.lit("G1").alias("event_id"), F.lit("A").alias("unit_name"), "kind", F.col("messageId").alias("message"), "version", F.col("publicationDate").alias("published_text"),
        blank("type_text"), blank("reason_code_text"), blank("reason"), "remarks", "units")
    assert dc.render_document(v).first().body.split("\n") == [
        "Event: G1 (A, generation)", "Message: m1 version 1", "Published: 2023-12-31T12:00:00Z", "Unavailability type: None", "Reason code: None", "Unavailability reason: None", "", "Time periods:",
        "  Unit/border: A", "    2024-01-01T00:00:00Z -> 2024-01-02T00:00:00Z: unavailable 10.5 MW, available None MW", "    None -> None: unavailable None MW, available 3.0 MW", "  Unit/border: None",
        "", "Remarks:", "two", "lines"]
    empty = v.withColumn("units", F.lit(None).cast(v.schema["units"].dataType)).withColumn("remarks", F.lit(""))
    assert dc.render_document(empty).first().body.split("\n")[7:] == ["Time periods:", "", "Remarks:", "(none)"]


def test_numbered_names_are_looked_up_without_candidates(spark):
    """Names that differ in a number share all short pieces; the work must be that of the pieces, not of pairs."""
    n = 3000
    messages = spark.range(n).select(F.col("id").alias("m"), F.col("id").alias("ord"), F.lit(None).cast("bigint").alias("unit"), F.format_string("Unit#%09d", "id").alias("name"), F.lit(None).cast("string").alias("remarks"))
    outages = spark.range(n).select(F.col("id").alias("o"), F.lit(None).cast("bigint").alias("unit"), F.format_string("%09d", "id").alias("name"))
    got = ma.unit_name_match(outages, messages, "o", "m", "ord", "unit", "name", "remarks")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "contains(" not in plan.lower()
    assert got.where("matched and o = m").count() == n


def test_window_mean_needs_only_the_hours_of_the_events(spark):
    from hourloom.operators import intervals as iv

    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    i = spark.createDataFrame([("u", t(0), t(5), 2.0), ("u", t(3), t(9), 4.0), ("v", t(0), t(9), 8.0)], "unit string, start timestamp, end timestamp, x double")
    e = spark.createDataFrame([("e1", "u", t(2), t(6)), ("e2", "u", t(4), t(6)), ("e3", "u", t(6), t(6))], "event string, unit string, start timestamp, end timestamp")
    asked = ma.window_hours(e, ["unit"], "event").select("unit", "ts").distinct()
    assert asked.count() == 4
    total = iv.sweep_line_sum(i, ["unit"], "start", "end", "x", asked)
    got = {r.event: r.window_mean for r in ma.window_mean(e, total, ["unit"], "event", "ts", "total").collect()}
    assert got == {"e1": (2 + 6 + 6 + 4) / 4, "e2": 5.0}


def test_candidates_outside_the_time_of_all_threads_are_not_shuffled(spark):
    t = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    cand = spark.createDataFrame([("early", 1, t(0), t(10)), ("meets", 1, t(10), t(14)), ("late", 1, t(20), t(30)), ("inside", 1, t(12), t(13))], "row string, unit int, start timestamp, end timestamp")
    threads = spark.createDataFrame([("m1", 1, t(10), t(20)), ("m2", 1, t(12), t(14)), ("none", 1, None, None), ("empty", 1, t(40), t(2))], "message string, unit int, start timestamp, end timestamp")
    pairs = ma.overlap_pairs(cand, threads, "unit", "row", "message")
    assert {(r.row, r.message) for r in pairs.collect()} == {("meets", "m1"), ("meets", "m2"), ("inside", "m1"), ("inside", "m2")}
    assert "scalar-subquery" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert ma.overlap_pairs(cand, threads.limit(0), "unit", "row", "message").count() == 0
