"""Versioned documents: bounds, point-in-time sets, rendering, cached effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.functions.text import strip
from hourloom.operators import running, timeline


# ------------------------------------------------------------ version facts
def version_record(periods: DataFrame, keys: list[str], start: str, end: str, mw: str) -> DataFrame:
    """Envelope of a version's periods: earliest start, latest end, largest magnitude (missing counts as 0).

    Versions without any dated period keep NULL bounds.
    """
    dated = F.col(start).isNotNull() & F.col(end).isNotNull()
    return periods.groupBy(*keys).agg(
        F.min(F.when(dated, F.col(start))).alias(start), F.max(F.when(dated, F.col(end))).alias(end),
        F.max(F.when(dated, F.coalesce(mw, F.lit(0.0)))).alias(mw), F.count_if(dated).alias("n_periods"),
    )


def revision_surprise(
    versions: DataFrame, by: list[str], version: str, end: str, mw: str, stop_hours: float = 6.0,
    jump: float = 100.0, bucket: int = 10_000,
) -> DataFrame:
    """Did the end move by more than `stop_hours`, or the magnitude by more than `jump`, between neighbouring
    versions that have bounds?"""
    dated = versions.where(F.col(end).isNotNull()).withColumn("__now", F.struct(end, mw))
    stepped = running.previous_value(dated, by, version, "__now", "__before", bucket)
    moved = F.abs(cal.hours_between(F.col("__before").getField(end), F.col(end))) > stop_hours
    resized = F.abs(F.col(mw) - F.col("__before").getField(mw)) > jump
    surprise = F.coalesce(moved, F.lit(False)) | F.coalesce(resized, F.lit(False))
    seen = stepped.groupBy(*by).agg(F.bool_or(surprise).alias("surprise"))
    everyone = versions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_versions"))
    return everyone.join(seen, by, "left").withColumn("surprise", F.coalesce("surprise", F.lit(False)))


def first_nonnull_version(versions: DataFrame, by: list[str], name: str, published: str, version: str) -> DataFrame:
    """The first known name of a thread in publication order."""
    order = F.when(F.col(name).isNotNull(), F.struct(published, version))
    return versions.groupBy(*by).agg(F.min_by(name, order).alias(name))


def lead_time_hours(events: DataFrame, versions: DataFrame, key: str, start: str, published: str) -> DataFrame:
    """Hours between a thread's first publication and the event's start."""
    first = versions.groupBy(key).agg(F.min(published).alias("first_published"))
    return events.join(first, key, "left").withColumn(
        "lead_hours", cal.hours_between(F.col("first_published"), F.col(start))
    )


# ------------------------------------------------------------ point in time
def asof_document_set(
    event_days: DataFrame, versions: DataFrame, key: str, tz: str, published: str = "published"
) -> DataFrame:
    """All versions published by the forecast origin of each delivery day: the full history, as rows."""
    asked = event_days.withColumn("t0", cal.gate_time(F.col("day"), tz))
    return asked.join(versions, key).where(F.col(published) <= F.col("t0"))


def asof_event_documents(events: DataFrame, versions: DataFrame, key: str, tz: str, start: str, end: str, published: str = "published") -> DataFrame:
    """`asof_document_set` of every local day of the events: events meet versions first and are spread over their days after that, so no event-day is shuffled."""
    days = timeline.event_days(events.join(versions, key), start, end, tz)
    return days.withColumn("t0", cal.gate_time(F.col("day"), tz)).where(F.col(published) <= F.col("t0"))


def _show(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


# The layout of a rendered version and of a document set's blocks (`assemble_context`).
def period_line(p: Column) -> Column:
    return F.concat(
        F.lit("    "), _show(p["start"]), F.lit(" -> "), _show(p["end"]), F.lit(": unavailable "), _show(p["mw"]),
        F.lit(" MW, available "), _show(p["available"]), F.lit(" MW"),
    )


def unit_lines(u: Column) -> Column:
    return F.concat(F.array(F.concat(F.lit("  Unit/border: "), _show(u["name"]))), F.transform(u["periods"], period_line))


def render_document(versions: DataFrame, out: str = "body") -> DataFrame:
    """Fixed-layout text of a version, with all its units and their periods.

    Columns used: event_id, unit_name and kind (of the event), message, version, published_text, type_text, reason_code_text,
    reason, remarks, and units ARRAY<STRUCT<name, periods ARRAY<STRUCT<start, end, mw, available>>>> (texts and numbers). Missing values show as None,
    a version without units has no lines under "Time periods:", missing or empty remarks show as (none).
    """
    show = lambda c: _show(F.col(c))
    head = F.array(
        F.concat(F.lit("Event: "), show("event_id"), F.lit(" ("), show("unit_name"), F.lit(", "), show("kind"), F.lit(")")),
        F.concat(F.lit("Message: "), show("message"), F.lit(" version "), show("version")),
        F.concat(F.lit("Published: "), show("published_text")),
        F.concat(F.lit("Unavailability type: "), show("type_text")),
        F.concat(F.lit("Reason code: "), show("reason_code_text")),
        F.concat(F.lit("Unavailability reason: "), show("reason")),
        F.lit(""), F.lit("Time periods:"),
    )
    units = F.coalesce(F.flatten(F.transform("units", unit_lines)), F.expr("cast(array() as array<string>)"))
    remarks = F.coalesce(F.nullif(F.col("remarks"), F.lit("")), F.lit("(none)"))
    return versions.withColumn(out, F.array_join(F.concat(head, units, F.array(F.lit(""), F.lit("Remarks:"), remarks)), "\n"))


def assemble_context(documents: DataFrame, by: list[str], published: str, version: str, body: str) -> DataFrame:
    """Blocks of a document set in (publication, version) order, separated by blank lines.

    One group is the history of one event's thread, the text that a reader is handed as a whole.
    """
    ordered = _blocks(published, version, body)
    return documents.groupBy(*by).agg(
        F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"),
        F.count(F.lit(1)).alias("n_documents"),
    )


def _blocks(published: str, version: str, body: str) -> Column:
    """The blocks of a group's versions as an array of (p: published, v: version, b: text), in order."""
    block = F.concat(
        F.lit("--- version "), F.col(version).cast("string"), F.lit(" | published "),
        F.date_format(published, "yyyy-MM-dd HH:mm:ss"), F.lit(" ---\n"), strip(F.col(body)),
    )
    return F.sort_array(F.collect_list(F.struct(F.col(published).alias("p"), F.col(version).alias("v"), block.alias("b"))))


def event_day_contexts(
    events: DataFrame, versions: DataFrame, key: str, tz: str, event: str, start: str, end: str, published: str, version: str, body: str
) -> DataFrame:
    """`assemble_context` of `asof_event_documents` per (event, day).

    What is known on a day is the beginning of the thread's blocks, so these are made once per thread, and a text is shuffled once, not once for each
    event-day on which it is known. A thread is the text that a reader is handed as a whole. Event-days without a known version have no row.
    """
    threads = versions.groupBy(key).agg(_blocks(published, version, body).alias("__blocks"))
    days = timeline.event_days(events.select(event, key, start, end).join(threads, key), start, end, tz)
    days = days.withColumn("__t0", cal.gate_time(F.col("day"), tz))
    seen = days.select(event, "day", F.filter("__blocks", lambda x: x["p"] <= F.col("__t0")).alias("__seen")).where(F.size("__seen") > 0)
    return seen.select(event, "day", F.array_join(F.transform("__seen", lambda x: x["b"]), "\n\n").alias("context"), F.size("__seen").cast("bigint").alias("n_documents"))


# ------------------------------------------------------------ effects, cache
# Field names of an effect.
EFFECT_SCHEMA = (
    "reasoning string, p_active double, start_hour struct<mean:double,sd:double>, "
    "end_hour struct<mean:double,sd:double>, size_mw struct<p10:double,p50:double,p90:double>, direction string"
)


def validate_effect(df: DataFrame, text: str) -> DataFrame:
    """Parse a bounded effect and say what is wrong with it: adds `effect` and `reason` (NULL when valid)."""
    e = F.from_json(F.col(text), EFFECT_SCHEMA)
    keys = lambda path: F.array_sort(F.json_object_keys(F.get_json_object(F.col(text), path)))
    exact = lambda path, names: F.coalesce(keys(path) == F.array(*map(F.lit, sorted(names))), F.lit(False))
    ok = lambda c: F.coalesce(c, F.lit(False))
    hour = lambda c: ok(c["mean"].between(0.0, 24.0) & c["sd"].between(0.0, 12.0))
    p = F.col("effect")
    names = ["reasoning", "p_active", "start_hour", "end_hour", "size_mw", "direction"]
    q = p["size_mw"]
    ordered = ok((q["p10"] >= 0) & (q["p10"] <= q["p50"]) & (q["p50"] <= q["p90"]))
    checks = [
        (~exact("$", names), "unexpected keys"),
        (~ok(p["p_active"].between(0.0, 1.0)), "invalid p_active"),
        (~(exact("$.start_hour", ["mean", "sd"]) & hour(p["start_hour"])), "invalid start_hour"),
        (~(exact("$.end_hour", ["mean", "sd"]) & hour(p["end_hour"])), "invalid end_hour"),
        (~(exact("$.size_mw", ["p10", "p50", "p90"]) & ordered), "invalid size_mw"),
        (~ok(p["direction"].isin("reduce", "none")), "invalid direction"),
        (~ok(strip(p["reasoning"]) != ""), "empty reasoning"),
    ]
    reason = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return df.withColumn("effect", e).withColumn("reason", reason)


def content_key(*parts: Column) -> Column:
    """Cache key of the inputs: a digest of their canonical JSON."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with the cached answer and a `cache_hit` flag. Of the answers cached under one key the smallest row counts."""
    once = cache.groupBy(key).agg(F.min(F.struct(*[c for c in cache.columns if c != key])).alias("__hit"))
    return requests.join(once, key, "left").select(
        *requests.columns, "__hit.*", F.col("__hit").isNotNull().alias("cache_hit")
    )


def to_json_array(values: Column) -> Column:
    return F.to_json(values)


def from_json_array(text: Column) -> Column:
    """A JSON list of numbers; anything else becomes an empty list."""
    parsed = F.from_json(text, "array<double>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.expr("cast(array() as array<double>)"))


def language_shares(labelled: DataFrame, by: list[str], label: str = "label", ambiguous: str = "ambiguous") -> DataFrame:
    n, empty = F.count(F.lit(1)), F.count_if(F.col(label) == "empty")
    return labelled.groupBy(*by).agg(
        n.alias("n_total"), empty.alias("n_empty"), F.count_if(F.col(label) == "english").alias("n_english"),
        F.count_if(F.col(label) == "foreign").alias("n_foreign"), F.count_if(ambiguous).alias("n_ambiguous"),
        (F.count_if(F.col(label) == "english") / F.nullif(n - empty, F.lit(0))).alias("share_english"),
    )


